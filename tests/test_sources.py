import io
import zipfile
import zlib

import pytest

from quillmill.sources import files
from quillmill.sources.pdf import pdf_pages


def make_pdf(pages, *, packed=False, compress=True):
    """A PDF by hand: each page is its content; font F1 is single-byte, F2 has a map to Unicode."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0416> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<00E9> <0066006A>] endbfrange"
    stream = lambda data: b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(zlib.compress(data)), b"/Filter /FlateDecode", zlib.compress(data)) if compress else b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data)
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (len(pages), b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))), 3: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"}
    with_streams = {5: stream(cmap)}
    for i, content in enumerate(pages):
        plain[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        with_streams[11 + 2 * i] = stream(content)
    if packed:
        places, body = [], b""
        for number, value in plain.items():
            places.append(b"%d %d" % (number, len(body)))
            body += value + b" "
        head = b" ".join(places) + b" "
        data = zlib.compress(head + body)
        plain, with_streams[99] = {}, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(places), len(head), len(data), data)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in (plain | with_streams).items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [
    rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\366rld) Tj 0 -14 Td [(Next) -250 (line ) 20 (go) 10 (es on)] TJ T* (and a third) ' ET BT /F1 9 Tf 1 0 0 1 72 40 Tm (Page 1) Tj ET",
    rb"BT /F2 12 Tf 72 700 Td <00010002000300040005> Tj ( \000\006) Tj ET",
    rb"q 1 0 0 1 0 0 cm Q",
]


@pytest.mark.parametrize("options", [{}, {"packed": True}, {"compress": False}])
def test_pdf_pages(options):
    first, second, third = pdf_pages(make_pdf(PAGES, **options))
    assert first == "Hello (big) wörld\nNext line goes on\n\nand a third\nPage 1".replace("\n\n", "\n")
    assert second.startswith("Жabcé") and second.endswith("fj") and third == ""


def test_pdf_refusals():
    with pytest.raises(ValueError, match="no PDF"):
        pdf_pages(b"plain")
    with pytest.raises(ValueError, match="encrypted"):
        pdf_pages(make_pdf(PAGES).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 8 0 R"))
    circle = make_pdf(PAGES).replace(b"/Kids [10 0 R", b"/Kids [2 0 R 10 0 R")
    assert len(pdf_pages(circle)) == 3


def make_docx(paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r><w:r><w:t> end</w:t></w:r></w:p>" if x else "<w:p/>" for x in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_every_type_is_read(spark, tmp_path):
    made = {"a.pdf": make_pdf(PAGES), "b.docx": make_docx(["One", "", "Two"]), "c.html": b"<p>x</p><script>no</script>", "d.csv": b"k,v\n1,2\n", "e.md": "# T\nü".encode(), "f.TXT": b"bad \xff byte", "g.pdf": b"%PDF-1.4 nothing"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r.filename: r for r in files.extract_documents(files.scan_folder(spark, str(tmp_path))).collect()}
    assert got["a.pdf"].raw_text.startswith("Hello (big) wörld") and got["a.pdf"].page_count == 2 and got["a.pdf"].mime_type == "application/pdf"
    assert got["b.docx"].raw_text == "One end\nTwo end" and got["c.html"].raw_text == "x" and got["d.csv"].raw_text == "k: 1 | v: 2"
    assert got["e.md"].raw_text == "# T\nü" and got["f.TXT"].raw_text == "bad � byte" and got["f.TXT"].doc_type == "txt"
    assert got["g.pdf"].raw_text == "" and got["g.pdf"].page_count == 0 and all(r.error is None for r in got.values())
