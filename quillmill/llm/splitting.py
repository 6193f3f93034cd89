"""Splitting oversized texts at natural boundaries by pointer doubling.

Every word position is a possible start of a piece.  One vectorised search joins each position to its
farthest legal end (a paragraph, line or sentence end where one lies in reach, else the size limit); the start
of the next piece is that end less the overlap.  Squaring this successor table again and again doubles the set of known
cuts, so that all pieces of all texts of a batch are found in log2(pieces) vector steps.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.termhash import codes_of, small_batches

#: Characters that end a sentence, and closing marks that may follow them.
_ENDS = ".!?。！？…"
_CLOSERS = "\"'”’»)]』」"

CUT_TYPE = "array<struct<piece_no:int,first_word:int,words:int,char_from:int,chars:int>>"


@lru_cache(maxsize=1)
def _space_table() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text_start, word_start, word_end, words by text) of a batch; words are runs without white space."""
    codes, text_start = codes_of(texts)
    ink = ~_space_table()[codes]
    ink[text_start[1:] - 1] = False  # the NUL after each text
    flags = np.zeros(len(ink) + 2, dtype=np.int8)
    flags[1:-1] = ink
    edge = np.flatnonzero(np.diff(flags))
    start, end = edge[0::2], edge[1::2]
    at = np.searchsorted(start, text_start)
    return codes, text_start, start, end, np.diff(at)


def _tier(codes: np.ndarray, word_end: np.ndarray, next_start: np.ndarray) -> np.ndarray:
    """What ends after each word: 3 a paragraph, 2 a line, 1 a sentence, 0 nothing."""
    newline = np.concatenate([[0], np.cumsum(codes == 10)])
    breaks = newline[next_start] - newline[word_end]
    last = codes[word_end - 1]
    before = codes[np.maximum(word_end - 2, 0)]
    ends = np.array([ord(c) for c in _ENDS])
    closers = np.array([ord(c) for c in _CLOSERS])
    sentence = np.isin(last, ends) | (np.isin(last, closers) & np.isin(before, ends))
    return np.where(breaks > 1, 3, np.where(breaks == 1, 2, sentence.astype(np.int64)))


def _cut(codes, word_start, word_end, first, size, limit, overlap, floor):
    """Pieces of the texts whose words are first .. first + size: (text, start word, end word) arrays."""
    which = np.repeat(np.arange(len(first)), size)
    begin = np.concatenate([[0], np.cumsum(size)])
    total = int(begin[-1])
    word = np.arange(total) - begin[which] + first[which]
    text_end = begin[which + 1]
    follow = word_start[np.minimum(word + 1, len(word_start) - 1)]
    tier = _tier(codes, word_end[word], np.where(np.arange(total) + 1 < text_end, follow, word_end[word]))
    here = np.arange(total)
    most = np.minimum(here + limit[which], text_end)  # farthest end by size
    least = here + np.minimum(np.maximum(floor[which], overlap[which] + 1), limit[which])
    bare = here + np.minimum(overlap[which] + 1, limit[which])
    end = np.full(total, -1)
    for low in (least, bare):  # natural ends with enough words first, then any that makes headway
        for want in (3, 2, 1):
            ends = np.flatnonzero(tier >= want) + 1
            at = np.searchsorted(ends, most, side="right") - 1
            found = np.where(at >= 0, ends[np.maximum(at, 0)], -1) if len(ends) else np.full(total, -1)
            end = np.where((end < 0) & (found >= low), found, end)
    end = np.where(end < 0, most, end)
    end = np.where(text_end - here <= limit[which], text_end, end)
    done = end >= text_end
    jump = np.where(done, here, np.maximum(end - overlap[which], here + 1))
    known = begin[:-1][size > 0]
    while True:  # jump is the successor table to the power 1, 2, 4, ...
        more = np.union1d(known, jump[known])
        if len(more) == len(known):
            break
        known, jump = more, jump[jump]
    return which[known], known - begin[which[known]], end[known] - begin[which[known]]


def cut_texts(texts: list[str], limit: np.ndarray, overlap: np.ndarray, floor: np.ndarray) -> pa.Array:
    """Pieces of each text, as CUT_TYPE; a text without words has none.

    Pieces have at most `limit` words and share `overlap` words with the piece before; natural ends are used from `floor` words on, sooner
    only where none lies between.  Offsets are in code points.
    """
    limit = np.maximum(limit, 1)
    overlap = np.clip(overlap, 0, limit - 1)
    floor = np.clip(floor, 0, limit)
    codes, text_start, ws, we, count = words_of(texts)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    large = count > limit
    rows, s, e = [np.flatnonzero((count > 0) & ~large)], [], []
    s.append(np.zeros(len(rows[0]), dtype=np.int64))
    e.append(count[rows[0]])
    if large.any():
        big = np.flatnonzero(large)
        which, start, end = _cut(codes, ws, we, first[big], count[big], limit[big], overlap[big], floor[big])
        rows.append(big[which])
        s.append(start)
        e.append(end)
    row, start, end = np.concatenate(rows), np.concatenate(s), np.concatenate(e)
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    each = np.bincount(row, minlength=len(texts))
    offset = np.concatenate([[0], np.cumsum(each)])
    char_from = ws[first[row] + start] - text_start[row] if len(row) else row
    char_to = we[first[row] + end - 1] - text_start[row] if len(row) else row
    i32 = lambda x: pa.array(x.astype(np.int32))
    pieces = pa.StructArray.from_arrays([i32(np.arange(len(row)) - offset[row]), i32(start), i32(end - start), i32(char_from), i32(char_to - char_from)], ["piece_no", "first_word", "words", "char_from", "chars"])
    return pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pieces)


def cuts(text: Column, limit: Column, overlap: Column, floor: Column) -> Column:
    """Column of the pieces of `text` (CUT_TYPE), empty for null and blank texts."""

    @F.arrow_udf(CUT_TYPE)
    def run(text: pa.Array, limit: pa.Array, overlap: pa.Array, floor: pa.Array) -> pa.Array:
        # Texts are cut a few at a time, so that memory stays flat.
        parts = []
        for batch in small_batches([pa.RecordBatch.from_arrays([text, limit, overlap, floor], ["text", "limit", "overlap", "floor"])], 0):
            numbers = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3)]
            parts.append(cut_texts(["" if t is None else t for t in batch.column(0).to_pylist()], *numbers))
        return pa.concat_arrays(parts) if parts else cut_texts([], *(np.zeros(0, dtype=np.int64) for _ in range(3)))

    return run(text, limit, overlap, floor)


#: What has no limit counts as this long.
UNLIMITED = 1 << 40


def with_profile(records: DataFrame, profile: DataFrame, default: str = "txt") -> DataFrame:
    """Add max_tokens, overlap_tokens and min_tokens of each record's doc_type, as _max, _overlap and _min.

    doc_type is compared in lower case; a null or unknown one takes the row of `default`, and has no limit where there is none.  Of several rows of
    one type the least counts.  The profile is a small dimension table; Spark broadcasts it if its size allows.
    """
    p = profile.select(F.lower("doc_type").alias("_type"), F.struct(F.col("max_tokens").alias("_max"), F.col("overlap_tokens").alias("_overlap"), F.col("min_tokens").alias("_min")).alias("_p"))
    p = p.where("_type is not null").groupBy("_type").agg(F.min("_p").alias("_p"))
    fallback = p.where(F.col("_type") == default).first()
    own = [F.lit(v).cast("bigint") for v in (fallback["_p"] if fallback else (UNLIMITED, 0, 0))]
    typed = records.withColumn("_type", F.lower("doc_type")).join(p, "_type", "left").drop("_type")
    return typed.withColumns({n: F.when(F.col("_p").isNull(), v).otherwise(F.col(f"_p.{n}").cast("bigint")) for n, v in zip(("_max", "_overlap", "_min"), own)}).drop("_p")


def split_records(records: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per record of (tab, rec_key, doc_type, text, ...) with column `pieces` (CUT_TYPE) and the profile's limits.

    Null and blank texts have no pieces; a text within its limit has one.  Repeated records are each cut (alike).
    """
    limits = with_profile(records, profile)
    return limits.withColumn("pieces", cuts(F.col("text"), F.coalesce("_max", F.lit(UNLIMITED)), F.coalesce("_overlap", F.lit(0).cast("bigint")), F.coalesce("_min", F.lit(0).cast("bigint"))))
