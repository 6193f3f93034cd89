import random

from quillmill.llm.scan_repair import ScannedText, _symbols_and_keys, line_model
from quillmill.llm.scan_samples import FURNITURE, labelled_pages

WORDS = "the pump under every old bridge must always be cleaned before winter because otherwise water enters through small openings and damages several wooden panels inside".split()


def page_text(seed=3, pages=4, damage=True):
    r = random.Random(seed)
    lines, noise = [], set()
    for page in range(1, pages + 1):
        lines.append("Bridge Maintenance Manual")
        noise.add((len(lines), "furniture"))
        for k in range(14):
            line = " ".join(r.choice(WORDS) for _ in range(9))
            if damage and k == 5:
                line = line.rsplit(" ", 1)[0] + " other¬"
                lines.append(line)
                noise.add((len(lines), "hyphen"))
                lines.append("wise " + " ".join(r.choice(WORDS) for _ in range(8)))
                continue
            if damage and k == 9:
                line = line + " br1dge"
                lines.append(line)
                noise.add((len(lines), "glyph"))
                continue
            lines.append(line + ("." if k == 13 and page == pages else ""))
        lines.append(f"Page {page}")
        noise.add((len(lines), "furniture"))
    return "\n".join(lines), noise


def test_line_model_on_held_out_pages():
    model = line_model(150)
    right = total = hit = false = 0
    for lines, labels in labelled_pages(60, seed=77):
        got = model.labels(lines)
        for x, y, line in zip(got, labels, lines):
            if not line.strip():
                continue
            total += y == FURNITURE
            hit += y == FURNITURE and x == FURNITURE
            false += y != FURNITURE and x == FURNITURE
            right += 1
    assert hit / total > 0.9 and false / right < 0.01


def test_found_and_restored(spark):
    scan, noise = page_text()
    plain = "\n".join(" ".join(WORDS[i : i + 9]) + "." for i in range(12)) + "\nA water-\ntight panel and a water-tight door."
    rows = [("s", scan, 1), ("s", scan, 2), ("p", plain, 1), ("n", None, 1), ("e", "", 1), (None, scan, 1), ("b", " \n ", 1), ("w", "word " * 50_000, 1)]
    rows += [(f"x{i}", " ".join(WORDS) + ".", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "file_hash string, raw_text string, line_no int")
    kit = ScannedText(df, "file_hash", "raw_text", line_model(150))
    got = kit.found().collect()
    assert {r.file_hash for r in got} == {"s"}
    assert {(r.line_no, r.noise) for r in got} == noise and len(got) == len(noise)
    text = kit.text().collect()
    assert len(text) == 1 and "Page" not in text[0].text and "Manual" not in text[0].text and "otherwise" in text[0].text and "br1dge" not in text[0].text and "\n" not in text[0].text
    empty = ScannedText(df.limit(0), "file_hash", "raw_text", line_model(20))
    assert empty.found().count() == 0 and empty.text().count() == 0


def test_cut_words_are_a_trace_by_themselves(spark):
    cut = "the pump under every old bridge must always be cle-\naned before winter because other-\nwise water enters the panels inside"
    compound = "the pump under every old bridge has a water-\ntight panel and no water-tight door"
    df = spark.createDataFrame([("cut", cut), ("compound", compound), *((f"x{i}", " ".join(WORDS) + ".") for i in range(30))], "file_hash string, raw_text string")
    kit = ScannedText(df, "file_hash", "raw_text", line_model(20))
    assert {tuple(r) for r in kit.found().collect()} == {("cut", 1, "hyphen"), ("cut", 2, "hyphen")}
    assert [tuple(r) for r in kit.text().collect()] == [("cut", cut.replace("-\n", "").replace("\n", " "))]


def found_and_made(model, sizes, head=None, foot=None, stray=None):
    """Lines labelled furniture, and lines made as furniture, of pages of so many lines."""
    r, lines, made = random.Random(1), [], []
    for page, size in enumerate(sizes, 1):
        if head:
            made.append(len(lines))
            lines.append(head(page))
        lines += [(stray or {}).get((page, k)) or " ".join(r.choice(WORDS) for _ in range(9)) for k in range(size)]
        if foot:
            made.append(len(lines))
            lines.append(foot(page))
    return [i for i, x in enumerate(model.labels(lines)) if x == FURNITURE], made


def test_copies_are_judged_one_by_one():
    model, title = line_model(150), "Bridge Maintenance Manual"
    for pages in (
        dict(sizes=[30, 30, 30, 7, 30, 30], head=lambda p: title),
        dict(sizes=[30, 30, 30, 2, 30, 30], head=lambda p: title, foot=lambda p: f"Page {p}"),
        dict(sizes=[30] * 6, foot=str, stray={(3, 2): "212"}),
        dict(sizes=[30] * 6, head=lambda p: title, foot=str, stray={(3, 8): "212"}),
        dict(sizes=[30] * 6, foot=str, stray={(3, k): str(100 + k * 7) for k in range(5, 15)}),
    ):
        found, made = found_and_made(model, **pages)
        assert found == made
    # A variant in the middle leaves a gap of more than three pages between the others.
    found, made = found_and_made(model, [26, 26, 8, 26, 26, 26, 26, 26], lambda p: title + " draft" * (p in (4, 5, 6, 7)), lambda p: f"— {p} —")
    assert found == made


def test_no_limit_to_titles_and_repeated_lines():
    model = line_model(150)
    titles = ["Bridge Maintenance Manual", "Harbour Inspection Guide", "Winter Storage Handbook", "Pump Replacement Notes", "Valve Calibration Primer"]
    found, made = found_and_made(model, [30] * 25, lambda p: titles[(p - 1) // 5])
    assert found == made
    # A passage delivered twice is no header, whatever its lines.
    r = random.Random(4)
    lines = [" ".join(r.choice(WORDS) for _ in range(9)) for _ in range(30)]
    assert FURNITURE not in model.labels([*lines, *lines[5:25], *lines[8:20]])
    # A damaged lone copy joins its header among any number of repeated lines.
    rows = [f"{a}{b} {WORDS[a]} {WORDS[b]} of the list" for a in range(10) for b in range(10)]
    lines = [titles[0], *rows, titles[0], *rows, "Bridqe Maintenance Manual"]
    keys = _symbols_and_keys(lines)[1]
    assert keys[len(lines) - 1] == keys[0]
