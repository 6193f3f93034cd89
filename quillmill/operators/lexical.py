"""BM25 and boosts over the candidates of each query and collection, each such group scored in one piece.

With a candidate travels no text but its words: of the words that stand in most texts (at most FREQUENT, a list that is broadcast) two bytes and a count each,
of any others every occurrence.  The list decides how many bytes a text takes, never a score.  A group is what one collection has for one query, so it is small;
for candidates of any number there is retrieval.bm25.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from quillmill.functions.termhash import runs_of, small_batches

#: Words with a number of two bytes; different words that a task counts at a time; words of groups scored at once.
FREQUENT, COUNTED, SCORED = 1 << 16, 1 << 17, 1 << 18

#: Every byte that is part of no word as a blank.
_BLANKED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for c in range(256))
#: Words of a text in all; low and high byte of the numbers of its frequent words, ascending, and how often each occurs (255 at most, then it is named again); its other words.
_CODE = [("_len", IntegerType()), ("_low", BinaryType()), ("_high", BinaryType()), ("_times", BinaryType()), ("_rest", BinaryType())]


def lowered(text: Column) -> Column:
    """Lower case as bytes; null is empty."""
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


def _words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and underscores of a text in lower case."""
    return text.translate(_BLANKED).split()


def frequent_words(texts: DataFrame) -> Broadcast:
    """Numbers of the words that stand in most texts (one column: lowered)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            more = {w: n for w, n in seen.items() if n > 1}
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(more), pa.binary()), pa.array(list(more.values()), pa.int64())], ["word", "n"])

        for batch in small_batches(batches, 0):
            for text in batch.column(0).to_pylist():
                seen.update(set(_words(text)))
                if len(seen) > COUNTED:
                    yield counted()
        yield counted()

    rows = texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    best = rows.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()  # at most FREQUENT rows
    return texts.sparkSession.sparkContext.broadcast({bytes(r.word): k for k, r in enumerate(best)})


def _binary(lengths: list[int] | np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def coded(table: DataFrame, text_col: str, numbers: Broadcast) -> DataFrame:
    """The words of each text (lowered) in place of the text."""
    keep = [c for c in table.columns if c != text_col]
    schema = StructType([*table.select(*keep).schema.fields, *(StructField(*c) for c in _CODE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value
        for batch in small_batches(batches, len(keep)):
            total, held, ids, times, rest = [], [], [], [], []
            for text in batch.column(len(keep)).to_pylist():
                found = _words(text)
                total.append(len(found))
                before, others = len(ids), []
                for word, n in Counter(found).items():
                    at = number.get(word)
                    if at is None:
                        others += [word] * n
                        continue
                    while n > 255:
                        ids.append(at)
                        times.append(255)
                        n -= 255
                    ids.append(at)
                    times.append(n)
                held.append(len(ids) - before)
                rest.append(b" ".join(others))
            named = np.array(ids, dtype=np.uint16)
            order = np.lexsort((named, np.repeat(np.arange(len(held)), held)))
            named, often = named[order], np.array(times, dtype=np.uint8)[order]
            columns = [_binary(held, (named & 255).astype(np.uint8)), _binary(held, (named >> 8).astype(np.uint8)), _binary(held, often)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(total, pa.int32()), *columns, pa.array(rest, pa.binary())], schema.names)

    return table.select(*keep, text_col).mapInArrow(run, schema)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows without nulls, and where each row begins and the last ends."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)), at - at[0]


def _sums(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=value, minlength=n)


class _Question:
    """What the query at hand asks for: numbers and counts of frequent words, counts of others, and the words of each of its texts."""

    def __init__(self, query: object = None):
        self.query, self.ids, self.times, self.rest, self.texts = query, [], [], Counter(), []

    def boosts(self, sections: list[bytes | None], files: list[bytes | None], section_boost: float, filename_boost: float) -> list[float]:
        """What each candidate of a group gets for its section path and its file name (no word of a query spans a line)."""
        best = [0.0] * len(files)
        every = b"\n".join(x for x in chain(set(sections), files) if x)
        for words in self.texts:
            named = [w for w in words if w in every]
            if not named:
                continue
            for i, (section, filename) in enumerate(zip(sections, files)):
                own = section_boost if section and any(w in section for w in named) else 0.0
                own += filename_boost if filename and any(w in filename for w in named) else 0.0
                best[i] = max(best[i], own)
        return best


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each key is among them, and how often it occurs; fast for keys in long ascending runs."""
    order = np.argsort(keys, kind="stable")
    lying = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = lying[1:] != lying[:-1]
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return lying[at], back, np.diff(np.append(at, len(keys)))


def _scorer(names: list[str], schema: pa.Schema, k1: float, b: float, epsilon: float, boosts: tuple[float, float]):
    """Rows by query and collection, the query's own row first, to its candidates with their scores."""

    def score(part: pa.RecordBatch, asked: _Question) -> tuple[pa.RecordBatch, _Question]:
        column = {c: part.column(c) for c in names}
        query, collection, doc, length, sections, files, words = (column[c].to_pylist() for c in ("query_id", "collection", "chunk_id", "_len", "_section", "_filename", "_words"))
        (low, at), (high, _), (times, _), rest = _bytes(column["_low"]), _bytes(column["_high"]), _bytes(column["_times"]), column["_rest"].to_pylist()
        ids = low.astype(np.int64) | high.astype(np.int64) << 8
        rows, group, docs, units = [], [], [], []  # of each candidate
        questions: list[_Question] = []  # of each group
        for i, q in enumerate(query):
            if q != asked.query:
                asked = _Question(q)
            if words[i] is not None:
                asked.texts.append(words[i])
                asked.ids.append(ids[at[i] : at[i + 1]])
                asked.times.append(times[at[i] : at[i + 1]])
                asked.rest.update(rest[i].split())
                continue
            new = not rows or (q, collection[i]) != (query[rows[-1]], collection[rows[-1]])
            if new:
                questions.append(asked)
            # Rows of one id are one text; with other counts of words, texts of one id.
            other = new or doc[i] != doc[rows[-1]]
            docs.append(docs[-1] + other if docs else 0)
            units.append(units[-1] + (other or length[i] != length[rows[-1]]) if units else 0)
            rows.append(i)
            group.append(len(questions) - 1)
        boost = []
        for k, same in groupby(zip(group, rows), key=lambda x: x[0]):
            own = [i for _, i in same]
            boost += questions[k].boosts([sections[i] for i in own], [files[i] for i in own], *boosts)
        taken, group, docs, units = (np.array(x, dtype=np.int64) for x in (rows, group, docs, units))
        n_docs, n_units, n_groups = (int(x[-1]) + 1 if len(x) else 0 for x in (docs, units, group))
        # Other words get numbers for as long as these rows are looked at.
        more: dict[bytes, int] = {}
        pairs = [(k, more.setdefault(w, FREQUENT + len(more))) for k, i in enumerate(rows) if rest[i] for w in rest[i].split()]
        own = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        bits = (FREQUENT + len(more)).bit_length()
        place = np.full(part.num_rows, -1, dtype=np.int64)
        place[taken] = np.arange(len(taken))
        owner = np.repeat(place, np.diff(at))
        use = owner >= 0
        row, word, n = np.concatenate([owner[use], own[:, 0]]), np.concatenate([ids[use], own[:, 1]]), np.concatenate([times[use].astype(np.float64), np.ones(len(own))])
        # How often each word stands in each text, and in how many texts of the group.
        pair, back, _ = _distinct((units[row] << bits) + word)
        tf, unit, word = _sums(back, n, len(pair)), pair >> bits, pair & ((1 << bits) - 1)
        of_unit = np.zeros(n_units, dtype=np.int64)
        of_unit[units] = np.arange(len(units))  # a row of each
        term, back, df = _distinct((group[of_unit[unit]] << bits) + word)
        size, lengths = np.bincount(group, minlength=n_groups), np.array([length[i] for i in rows], dtype=np.float64)
        average = _sums(group, lengths, n_groups) / np.maximum(size, 1)
        g = term >> bits
        idf = np.log(size[g] - df + 0.5) - np.log(df + 0.5)
        mean = _sums(g, idf, n_groups) / np.maximum(np.bincount(g, minlength=n_groups), 1)
        idf = np.where(idf < 0, epsilon * mean[g], idf)
        # How often the group's query asks for each of its words.
        times_asked = np.zeros(len(term))
        for k, question in enumerate(questions):
            known = [(more[w], c) for w, c in question.rest.items() if w in more]
            named = np.concatenate([*question.ids, np.array([w for w, _ in known], dtype=np.int64)])
            often = np.concatenate([*question.times, np.array([c for _, c in known], dtype=np.int64)])
            where = np.searchsorted(term, named := named + (k << bits))
            there = where < len(term)
            there[there] = term[where[there]] == named[there]
            np.add.at(times_asked, where[there], often[there].astype(np.float64))
        hit = times_asked[back] > 0
        back, tf, at_row = back[hit], tf[hit], of_unit[unit[hit]]
        value = times_asked[back] * idf[back] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[at_row] / average[group[at_row]]))
        sums = _sums(docs[at_row], value, n_docs)
        out = part.take(pa.array(taken)).select(schema.names[:-2])
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(sums[docs]), pa.array(boost, pa.float64())], schema=schema), asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        asked = _Question()

        def bounds(part: pa.RecordBatch) -> list[int]:
            """Where groups begin."""
            keys = list(zip(part.column("query_id").to_pylist(), part.column("collection").to_pylist()))
            return [i for i, key in enumerate(keys) if not i or key != keys[i - 1]]

        for batch in chain(batches, [None]):
            part = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
            if part is None or not part.num_rows:
                continue
            starts = bounds(part)
            # The last group may go on in the next batch.
            end = part.num_rows if batch is None else starts[-1]
            held = part.slice(end)
            edges = [*(s for s in starts if s < end), end]
            weight = np.concatenate([[0], np.cumsum(_weights(part))])
            for lo, hi in runs_of([int(weight[y] - weight[x]) for x, y in zip(edges, edges[1:])], SCORED):
                out, asked = score(part.slice(edges[lo], edges[hi] - edges[lo]), asked)
                if out.num_rows:
                    yield out

    return run


def _weights(part: pa.RecordBatch) -> np.ndarray:
    return np.diff(_bytes(part.column("_low"))[1]) + np.diff(_bytes(part.column("_rest"))[1]) // 4 + 1


def scored_candidates(candidates: DataFrame, queries: DataFrame, details: DataFrame, words: Column, *, k1: float, b: float, epsilon: float, boosts: tuple[float, float]) -> DataFrame:
    """sparse_score and metadata_boost of each candidate (query_id, collection, chunk_id and others) that details know.

    queries: query_id, query; details: chunk_id, collection, text, section_path, filename; `words` are those of a query that are looked for in the latter two.
    The corpus of a score is the candidates of the same query and collection.
    """
    numbers = frequent_words(details.select(lowered(F.col("text")).alias("_text")))
    low = lambda c: F.lower(F.col(c)).cast("binary")
    texts = coded(details.where("chunk_id is not null and collection is not null").select("chunk_id", "collection", low("section_path").alias("_section"), low("filename").alias("_filename"), lowered(F.col("text")).alias("_text")), "_text", numbers)
    asked = coded(queries.where("query_id is not null").select("query_id", F.transform(F.array_distinct(words), lambda w: w.cast("binary")).alias("_words"), lowered(F.col("query")).alias("_text")), "_text", numbers)
    rows = candidates.join(texts.dropDuplicates(["chunk_id", "collection"]), ["chunk_id", "collection"]).unionByName(asked, allowMissingColumns=True)
    lying = rows.repartition("query_id").sortWithinPartitions("query_id", F.asc_nulls_first("collection"), F.asc_nulls_first("chunk_id"), "_len")
    schema = StructType([*candidates.schema.fields, *StructType.fromDDL("sparse_score double, metadata_boost double").fields])
    schema = StructType([StructField(f.name, f.dataType) for f in schema.fields])
    return lying.mapInArrow(_scorer(lying.columns, to_arrow_schema(schema), k1, b, epsilon, boosts), schema)
