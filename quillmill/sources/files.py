"""Finding files, identity by content, and text by file type."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.sources.pdf import pdf_pages

# File types that are read, and their MIME types.
EXTENSIONS = ("pdf", "docx", "txt", "md", "html", "csv")
MIME_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "csv": "text/csv"}
DEFAULT_COLLECTION = "documents"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def mime_type(suffix: Column) -> Column:
    known = F.element_at(F.create_map(*(F.lit(x) for p in MIME_TYPES.items() for x in p)), suffix)
    return F.coalesce(known, F.lit("application/octet-stream"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS) + "}"  # suffixes in any letter case


def _named(files: DataFrame) -> DataFrame:
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.where(supported(F.col("path"))).select(path.alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("filename"), extension(F.col("path")).alias("doc_type"), "modificationTime", "length", content_hash(F.col("content")).alias("file_hash"), "content")


def scan_folder(spark: SparkSession, folder: str, quiet_seconds: float = 0.0) -> DataFrame:
    """All supported files below a folder with their content hash; files changed within the last `quiet_seconds` are left for later."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB).load(folder)
    if quiet_seconds:
        files = files.where(F.col("modificationTime") < F.current_timestamp() - F.expr(f"interval {quiet_seconds} seconds"))
    return _named(files)


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of new files.  A file changed in place is not read again: scan for those from time to time."""
    return _named(spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB).load(folder))


def stable_files(readings: DataFrame, polls: int = 3) -> DataFrame:
    """Files whose size stayed the same `polls` readings in a row within the first 2 * polls: readings (file_path, reading_no, length)."""
    own = Window.partitionBy("file_path").orderBy("reading_no")
    rows = readings.where("length is not null").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= 2 * polls)
    fresh = F.coalesce((F.col("length") != F.lag("length").over(own)).cast("int"), F.lit(1))
    runs = rows.withColumn("_run", F.sum(fresh).over(own)).groupBy("file_path", "_run").agg(F.count(F.lit(1)).alias("same"))
    return runs.where(F.col("same") > polls).select("file_path").distinct()


def collection_for(path: Column, root: str) -> Column:
    """The first folder below `root`, made safe, or the default for files right in it or elsewhere."""
    below = F.regexp_extract(path, "^" + re.escape(root.rstrip("/")) + "/+(.*)$", 1)
    first = F.when(F.contains(below, F.lit("/")), F.split(below, "/")[0]).otherwise("")
    name = F.lower(F.regexp_replace(F.regexp_replace(first, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(DEFAULT_COLLECTION))


def collections(chunks: DataFrame) -> DataFrame:
    return chunks.select("collection").where("collection is not null").distinct()


def configured_collections(value: str | None) -> list[str] | None:
    """Names of a comma list, trimmed, or None for all."""
    names = [x.strip() for x in (value or "").split(",") if x.strip()]
    return names or None


def csv_text(df: DataFrame, columns: list[str]) -> Column:
    """`name: value` pairs of a row, joined by ` | `; null and empty values are left out."""
    text = lambda c: F.col(c).cast("string")
    return F.concat_ws(" | ", *(F.when(F.coalesce(text(c), F.lit("")) != "", F.concat(F.lit(f"{c}: "), text(c))) for c in columns))


class _HtmlText(HTMLParser):
    SKIPPED = {"script", "style", "nav", "footer", "header"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIPPED

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIPPED and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def html_to_text(html: str) -> str:
    """Text nodes joined by line feeds, without scripts, styles, navigation, headers and footers."""
    parser = _HtmlText()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts)


def docx_to_text(content: bytes) -> str:
    """Paragraphs that are not blank, joined by line feeds."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    lines = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in ([] if body is None else body.findall(f"{w}p"))]
    return "\n".join(x for x in lines if x.strip())


def csv_to_text(content: bytes) -> str:
    import csv

    rows = csv.DictReader(io.StringIO(content.decode("utf-8", "replace")))
    return "\n".join(" | ".join(f"{k}: {v}" for k, v in row.items() if k and v and isinstance(v, str)) for row in rows)


PdfReader = Callable[[bytes], list[str]]


def _pdf_pages(content: bytes) -> list[str]:
    """Pages by pdfplumber where it is installed, else by the reader of our own."""
    try:
        import pdfplumber
    except ImportError:
        return pdf_pages(content)
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [page.extract_text() or "" for page in pdf.pages]


def extract_documents(files: DataFrame, pdf_reader: PdfReader | None = None) -> DataFrame:
    """Raw documents of scanned files (file_path, filename, doc_type, file_hash, content).

    A file that cannot be read has null raw_text and the error in `error`.  page_count is that of PDF pages with text.
    """
    read_pdf = pdf_reader or _pdf_pages

    def one(kind: str, content: bytes) -> tuple[str | None, int | None, str | None]:
        try:
            if kind == "pdf":
                pages = [p for p in read_pdf(content) if p]
                return "\n\n".join(pages), len(pages), None
            if kind == "docx":
                return docx_to_text(content), None, None
            if kind == "html":
                return html_to_text(content.decode("utf-8", "replace")), None, None
            if kind == "csv":
                return csv_to_text(content), None, None
            return content.decode("utf-8", "replace"), None, None
        except Exception as error:  # noqa: BLE001 - one bad file must not end the job
            return None, None, f"{type(error).__name__}: {error}"[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(k, bytes(c or b"")) for k, c in zip(batch["doc_type"], batch["content"])]
            yield batch.drop(columns="content").assign(raw_text=[g[0] for g in got], page_count=pd.array([g[1] for g in got], dtype="Int32"), error=[g[2] for g in got])

    base = files.select("file_path", "file_hash", "doc_type", "filename", "content")
    out = base.mapInPandas(run, "file_path string, file_hash string, doc_type string, filename string, raw_text string, page_count int, error string")
    return out.withColumn("mime_type", mime_type(F.col("doc_type"))).withColumn("extracted_at", F.current_timestamp())


def html_text(c: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else html_to_text(v) for v in values.to_pylist()], pa.string())

    return run(c)


def plain_text(content: Column) -> Column:
    """Bytes as UTF-8, bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))
