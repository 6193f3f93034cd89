"""Text quality statistics, and telling natural prose from lists, tables, listings and junk.

Every line gets features of its own and of its block, worked out for a whole Arrow batch at once (line_features.py).  Two rule lists, one for
headings and one for lines that are no prose, are induced by incremental reduced-error pruning on a bounded set of labelled texts
and turned into CASE expressions, which Spark evaluates without Python.  A record is no prose if more than half of its words
(headings left out) stand in lines that are no prose.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.termhash import small_batches
from quillmill.llm.irep import Rule, induce, to_case
from quillmill.llm.line_features import line_table, statistics, word_hashes
from quillmill.llm.quality_samples import labelled_texts

#: Labelled texts that the rules are induced from, and their seed.
TRAINING_TEXTS, TRAINING_SEED = 2500, 11

#: Features that headings are told by; all f_* features tell prose.
_HEADING = ("f_alone", "f_frame", "f_upper", "f_closed", "f_words", "f_sentences", "f_commas", "f_joints", "f_code", "f_pairs", "f_digits", "f_bmarker")
_FRAMES = ("f_alone", "f_frame")
_NAMES = tuple(k for k in line_table([], np.zeros(0, dtype=np.uint64)) if k.startswith("f_"))


def _body(text: str) -> str:
    """The text without its opening `Document:` and `Section:` lines."""
    for opening in ("Document: ", "Section: "):
        if text.startswith(opening):
            text = text.partition("\n")[2]
    return text


def line_features(texts: DataFrame, text_col: str, common: list[str]) -> DataFrame:
    """One row per line that is not blank: the other columns of `texts`, word_count and the features f_*.

    Opening `Document:` and `Section:` lines do not count; null texts have no lines.  Each text is worked on within its row and nothing is shuffled.
    Columns of `texts` must not be named word_count or f_*.
    """
    keep = [c for c in texts.columns if c != text_col]
    hashes = word_hashes(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, len(keep), 1 << 20):
            table = line_table([_body(t) if t else "" for t in batch.column(len(keep)).to_pylist()], hashes)
            row = pa.array(table["text"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(len(keep))), pa.array(table["words"]), *(pa.array(table[n]) for n in _NAMES)], [*keep, "word_count", *_NAMES])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields), "word_count bigint", *(f"{n} double" for n in _NAMES)])
    return texts.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


@lru_cache(maxsize=4)
def _rules(common: tuple[str, ...], texts: int, seed: int) -> tuple[tuple[Rule, ...], tuple[Rule, ...]]:
    samples = labelled_texts(texts, seed)
    table = line_table([t for _, t, _ in samples], word_hashes(list(common)))
    first = np.concatenate([[0], np.cumsum([len(ys) for _, _, ys in samples])])
    y = np.array([y for _, _, ys in samples for y in ys])[first[table["text"]] + table["line"]]
    weight = np.sqrt(table["words"].astype(float))
    heads = induce({n: table[n] for n in _HEADING}, y == 2, weight, seed=seed, longest=8)
    rest = y != 2
    other = induce({n: table[n][rest] for n in _NAMES if n not in _FRAMES}, y[rest] == 1, weight[rest], seed=seed)
    return tuple(heads), tuple(other)


def prose_rules(common: list[str], texts: int = TRAINING_TEXTS, seed: int = TRAINING_SEED) -> tuple[tuple[Rule, ...], tuple[Rule, ...]]:
    """The rules for headings and for lines that are no prose, induced once in a process for each list of common words."""
    return _rules(tuple(sorted(set(common))), texts, seed)


def line_labels(texts: DataFrame, text_col: str, common: list[str], rules: tuple[tuple[Rule, ...], tuple[Rule, ...]] | None = None) -> DataFrame:
    """line_features with columns `heading` and `other`, true for headings and for lines that are no prose."""
    heads, other = prose_rules(common) if rules is None else rules
    return line_features(texts, text_col, common).withColumns({"heading": F.expr(to_case(list(heads))), "other": F.expr(to_case(list(other)))})


def prose_shares(records: DataFrame, keys: list[str], text_col: str, common: list[str], rules: tuple[tuple[Rule, ...], tuple[Rule, ...]] | None = None) -> DataFrame:
    """(keys, counted_words, other_words, is_prose) for every record with at least one word that counts.

    Rows repeated under one key are taken together, which leaves the shares of equal rows as they are.  Null and blank texts
    and texts of headings only are in no row.  `common` are frequent function words in lower case; other columns are not read.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    rows = records.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col(text_col).alias("_text")).where("_text is not null")
    told = line_labels(rows, "_text", common, rules).where("not heading")
    sums = told.groupBy(*named).agg(F.sum("word_count").alias("counted_words"), F.sum(F.when(F.col("other"), F.col("word_count")).otherwise(0)).alias("other_words"))
    return sums.select(*(F.col(n).alias(k) for k, n in zip(keys, named)), "counted_words", "other_words", (F.col("other_words") * 2 <= F.col("counted_words")).alias("is_prose"))


_COUNTS = ("words", "ink", "symbols", "lines", "ended", "common")


def text_counts(text: Column, common: list[str]) -> Column:
    """Struct of counts: words, ink, symbols, lines, ended, common; zeros for null and blank texts."""
    hashes = word_hashes(common)

    @F.arrow_udf("struct<" + ",".join(f"{n}:bigint" for n in _COUNTS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        parts = [statistics(["" if t is None else t for t in b.column(0).to_pylist()], hashes) for b in small_batches([pa.RecordBatch.from_arrays([texts], ["t"])], 0, 1 << 20)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[n] for p in parts]) if parts else [], pa.int64()) for n in _COUNTS], list(_COUNTS))

    return run(text)


def text_statistics(records: DataFrame, text_col: str, common: list[str]) -> DataFrame:
    """The other columns of `records`, and word_count, mean_word_length, symbol_ratio, ended_lines, common_words.

    Shares of nothing (null, empty or blank texts) are null; their word count is 0.  Symbols are characters that are neither letter, digit nor white
    space; the ratio is to all characters that are not white space.  `common` is in lower case and compared with words without outer punctuation.
    """
    keep = [c for c in records.columns if c != text_col]
    counted = records.select(*keep, text_counts(F.col(text_col), common).alias("_n"))
    share = lambda a, b: F.when(F.col(f"_n.{b}") > 0, F.round(F.col(f"_n.{a}") / F.col(f"_n.{b}"), 6))
    return counted.select(*keep, F.col("_n.words").cast("int").alias("word_count"), share("ink", "words").alias("mean_word_length"), share("symbols", "ink").alias("symbol_ratio"), share("ended", "lines").alias("ended_lines"), share("common", "words").alias("common_words"))
