"""Text cleaning as column expressions; Unicode normalisation and the work line by line are Arrow passes, and each step names its input once.

Order matters and follows the published behaviour, quirks included: line joining also runs inside kept code, and a
join can cross a paragraph break.  Patterns carry (?d) so that only a line feed ends a line, and (?U) for Unicode white space.
Null text cleans to the empty string.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as drawing noise, and those that alone make up a separator line.
NOISE_CHARS = "|/\\+-=_*#<>:^~[](){}"
SEPARATOR_CHARS = "-=*_#~|+ "

_SPACE = r"[\s\x1c-\x1f]"
_NOT = lambda chars: "[^" + "".join("\\" + c if c in "\\[]^-" else c for c in chars) + "]"
_NOISE, _ONLY = _NOT(NOISE_CHARS), _NOT(SEPARATOR_CHARS)


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends; a run of it is tried once, from where it begins."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|(?<!{_SPACE}){_SPACE}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)(?<!{_SPACE}){_SPACE}+\z", "")


def normalize_nfkc(c: Column) -> Column:
    """Unicode compatibility normalisation; ASCII texts pass as they are."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    return run(c)


def drop_html_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def keep_code_blocks(c: Column) -> Column:
    """Turn fenced blocks into marked text: CODE_BLOCK for back-ticks, TILDE_BLOCK for tildes."""
    for fence, tag in (("```", "CODE_BLOCK"), ("~~~", "TILDE_BLOCK")):
        # Header trimmed of white space, body of line feeds at its edges.
        c = F.regexp_replace(c, rf"(?sU){fence}[ \t\r\f\x0b\x1c-\x1f\x85\p{{Zs}}]*([^\n`]*?)[ \t\r\f\x0b\x1c-\x1f\x85\p{{Zs}}]*\n\n*(.*?)\n*{fence}", f"\n{tag} $1\n$2\nEND_{tag}\n")
        c = F.regexp_replace(c, rf"(?m)^{tag} $", tag)
    return c


def drop_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def unwrap_inline_code(c: Column) -> Column:
    return F.regexp_replace(c, "`([^`\n]+)`", "$1")


def drop_page_numbers(c: Column) -> Column:
    """Lines that hold only digits, with a dash on either side or none; blank lines next to them go with them."""
    return F.regexp_replace(c, r"(?mdU)^\s*[-–—]?\s*\d+\s*[-–—]?\s*$", "")


def join_wrapped_lines(c: Column) -> Column:
    """A line feed before a lower-case letter becomes a space unless a stop and white space come before it."""
    return F.regexp_replace(c, r"(?<![.!?:][\s\x1c-\x1f\x85\p{Z}])\n(?=[a-z])", " ")


def is_ascii_art(line: Column) -> Column:
    """Whether a line is a drawing: enough signs and hardly a letter.  The stripped line is bound once."""
    left = lambda x, pattern: F.length(F.regexp_replace(x, pattern, ""))

    def told(x: Column) -> Column:
        letters, noise, pipes = left(x, r"[^\p{L}\p{N}]"), left(x, _NOISE), left(x, r"[^|]")
        return (F.length(x) >= 6) & (((letters == 0) & (noise >= 4)) | ((noise >= 8) & (letters <= 2)) | ((pipes >= 2) & (letters <= 3)) | ~x.rlike(_ONLY))

    return F.transform(F.array(strip(line)), told)[0]


def is_separator(line: Column) -> Column:
    """The same symbol five times or more, blanks between allowed."""
    return line.rlike(rf"(?U)^{_SPACE}*([=\-_*#~])({_SPACE}*\1){{4,}}{_SPACE}*$")


def is_table_divider(line: Column) -> Column:
    return line.rlike(rf"(?U)^{_SPACE}*\|?({_SPACE}*:?-{{3,}}:?{_SPACE}*\|)+{_SPACE}*:?-{{3,}}:?{_SPACE}*\|?{_SPACE}*$")


def table_row(line: Column) -> Column:
    """Cells joined by ` | `, without empty ones; a row of empty cells stays as it is."""
    cells = F.filter(F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), strip), lambda x: x != "")
    return F.when(line.contains("|") & (F.size(cells) > 0), F.array_join(cells, " | ")).otherwise(line)


_FOUR = re.compile(r"(?:[^\W_].*?){4}")
_DIVIDER = re.compile(r"\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-{3,}:?\s*\|?\s*")
_SAME_SIGN = re.compile(r"\s*([=\-_*#~])(?:\s*\1){4,}\s*")


def _drawn(line: str) -> bool:
    """is_ascii_art or is_separator of a line without white space at its ends."""
    letters, noise = sum(map(str.isalnum, line)), sum(map(line.count, NOISE_CHARS))
    if len(line) >= 6 and (letters == 0 and noise >= 4 or noise >= 8 and letters <= 2 or letters <= 3 and line.count("|") >= 2 or not line.strip(SEPARATOR_CHARS)):
        return True
    return _SAME_SIGN.fullmatch(line) is not None


def _flat_line(line: str) -> str | None:
    """One line as flatten_tables has it; None if it goes."""
    line = line.rstrip()
    bars = "|" in line
    # Four letters or digits make a line neither a divider nor a drawing.
    worded = _FOUR.search(line) is not None
    if not line or worded and not bars:
        return line
    if not worded and _DIVIDER.fullmatch(line):
        return None
    if bars:
        cells = [x for x in map(str.strip, line.strip().strip("|").split("|")) if x]
        line = " | ".join(cells) if cells else line
    return None if not worded and _drawn(line.strip()) else line


def flatten_tables(c: Column) -> Column:
    """Table rows as plain text; divider rows, drawings and separators dropped; blank lines kept; white space at lines' ends dropped."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else "\n".join([x for x in map(_flat_line, t.splitlines()) if x is not None]) for t in texts.to_pylist()], pa.string())

    return run(c)


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def trim_lines(c: Column) -> Column:
    """White space at lines' ends and at the text's ends dropped; every kind of line end becomes a line feed."""
    ends, blank = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "[ \t\x1f\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
    return strip(F.regexp_replace(F.regexp_replace(c, f"(?<!{blank}){blank}+(?={ends})", ""), ends, "\n"))


def clean(c: Column, normalize: bool = True) -> Column:
    """The whole cleaning pipeline."""
    c = F.coalesce(c, F.lit(""))
    if normalize:
        c = normalize_nfkc(c)
    for step in (drop_html_comments, keep_code_blocks, drop_control_chars, unwrap_inline_code, drop_page_numbers, join_wrapped_lines, flatten_tables, collapse_blanks, collapse_newlines):
        c = step(c)
    return strip(c)  # lines were trimmed with the tables
