"""Evaluation texts in training text, found with a generalised suffix automaton.

The automaton holds all runs of terms of the test passages.  Each document streams its terms through it and keeps, at
every term, the length of the longest run that ends there and stands in some passage.  Runs of at least
`min_terms` are leaks.  A term that no passage holds sends the automaton to its start, so stretches between such terms
that are shorter than `min_terms` are passed over without walking them.

Automata are built by the executors, each over at most about `block_terms` terms, and kept as flat arrays.  As many as fit in
`pass_bytes` are broadcast together, and the documents are read once for each such pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmill.functions.termhash import Terms, small_batches


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of small integers; each state knows its sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.items: list[set[int]] = [set()]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A copy of state q for the runs that reach it from p; p and its suffixes lead to the copy."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def mark(self, item: int, sequence: list[int]) -> None:
        """Note `item` in every state whose runs occur in `sequence`; call after all add()."""
        at = 0
        for symbol in sequence:
            at = self.next[at][symbol]
            up = at
            while up > 0 and item not in self.items[up]:
                self.items[up].add(item)
                up = self.link[up]


def _i32(values) -> np.ndarray:
    return np.fromiter(values, dtype=np.int32)


class LeakIndex:
    """Automaton, vocabulary and item numbers of one block of test passages, in flat arrays (some 40 bytes a state)."""

    def __init__(self, passages: list[list[int]], vocabulary: np.ndarray, min_terms: int, ids: list | None = None):
        auto = SuffixAutomaton()
        for p in passages:
            auto.add(p)
        for i, p in enumerate(passages):
            auto.mark(i, p)
        self.vocabulary, self.min_terms, self.ids = vocabulary, min_terms, list(range(len(passages))) if ids is None else ids
        self.first = np.concatenate([[0], np.cumsum(_i32(len(m) for m in auto.next))]).astype(np.int32)
        self.symbol, self.target = _i32(s for m in auto.next for s in sorted(m)), _i32(m[s] for m in auto.next for s in sorted(m))
        self.link, self.length = _i32(auto.link), _i32(auto.length)
        # The state of the last min_terms terms of any run that ends in a state: its items hold that run.
        self.short = np.arange(len(auto.next), dtype=np.int32)
        while (up := (self.short > 0) & (self.length[self.link[self.short]] >= min_terms)).any():
            self.short[up] = self.link[self.short[up]]
        self.first_item = np.concatenate([[0], np.cumsum(_i32(len(x) for x in auto.items))]).astype(np.int32)
        self.item = _i32(i for x in auto.items for i in sorted(x))
        self._view()

    _ARRAYS = ("first", "symbol", "target", "link", "length", "short", "first_item", "item")

    def _view(self) -> None:
        """Single values are read through memory views, which give plain integers."""
        for name in self._ARRAYS:
            setattr(self, f"_{name}", memoryview(np.ascontiguousarray(getattr(self, name))))

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in (*self._ARRAYS, "vocabulary", "min_terms", "ids")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._view()

    def items_of(self, state: int) -> list[int]:
        """The passages that hold the runs of a state."""
        return self._item[self._first_item[state] : self._first_item[state + 1]].tolist()

    def _step(self, state: int, symbol: int) -> int:
        lo, hi, symbols = self._first[state], self._first[state + 1], self._symbol
        while hi - lo > 1:
            middle = (lo + hi) >> 1
            if symbols[middle] <= symbol:
                lo = middle
            else:
                hi = middle
        return self._target[lo] if lo < hi and symbols[lo] == symbol else -1

    def matches(self, symbols: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) wherever the longest run ending before `end` has at least min_terms."""
        step, link, size, least = self._step, self._link, self._length, self.min_terms
        state = run = 0
        for end, symbol in enumerate(symbols, 1):
            to = step(state, symbol)
            while to < 0 < state:
                state = link[state]
                run = size[state]
                to = step(state, symbol)
            if to < 0:
                run = 0
            else:
                state, run = to, run + 1
            if run >= least:
                yield end, run, state

    def scan(self, terms: Terms, found: list[dict | None], places: list[np.ndarray | None]) -> None:
        """Add the hits and spans of this block to `found`, one entry for each text."""
        if not len(self.vocabulary) or not len(terms.hash):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, terms.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == terms.hash
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)) | np.concatenate([[1], np.diff(terms.owner) != 0, [1]]))
        starts, ends = edge[:-1], edge[1:]
        use = known[np.minimum(starts, len(known) - 1)] & (ends - starts >= self.min_terms)
        for lo, hi in zip(starts[use].tolist(), ends[use].tolist()):
            spans: list[list[int]] = []
            hits: dict[int, list[int]] = {}
            for end, run, state in self.matches(at[lo:hi].tolist()):
                begin = lo + end - run
                if spans and begin <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], begin)
                    spans[-1][1] = lo + end
                else:
                    spans.append([begin, lo + end])
                whole = set(self.items_of(state))
                for item in self.items_of(self._short[state]):
                    have = hits.setdefault(item, [0, 0, -1])
                    have[0] = max(have[0], run if item in whole else self.min_terms)
                    have[1] += (lo + end) - max(have[2], lo + end - self.min_terms)
                    have[2] = lo + end
            if not spans:
                continue
            row = int(terms.owner[lo])
            base, place = int(terms.text_start[row]), places[row]
            entry = found[row] = found[row] or {"hits": {}, "spans": [], "terms": int(terms.count[row])}
            for item, (longest, total, _) in hits.items():
                old = entry["hits"].get(self.ids[item], (0, 0))
                entry["hits"][self.ids[item]] = (max(old[0], longest), old[1] + total)
            for a, b in spans:
                from_, to = int(terms.start[a]) - base, int(terms.end[b - 1]) - base
                if place is not None:  # lower-casing changed lengths: back to characters as written
                    from_, to = int(place[from_]), int(place[to - 1]) + 1
                entry["spans"].append({"char_from": from_, "chars": to - from_, "first": a - int(terms.first[row]), "terms": b - a})


def _lowered(text: str) -> tuple[str, np.ndarray | None]:
    """The text in lower case and, where that changes its length, the character that each of its characters comes from."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    return low, np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])


def _building(min_terms: int, block_terms: int):
    """Rows (id, text) of a partition to automata over at most about `block_terms` terms each: (data, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[np.ndarray] = []
        size = 0

        def build() -> pa.RecordBatch:
            vocabulary = np.unique(np.concatenate(hashes))
            data = pickle.dumps(LeakIndex([np.searchsorted(vocabulary, h).tolist() for h in hashes], vocabulary, min_terms, list(ids)))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], ["data", "bytes"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = Terms([text.lower()]).hash
                if len(h) < min_terms:
                    continue
                if size and size + len(h) > block_terms:
                    yield build()
                    ids, hashes, size = [], [], 0
                ids.append(key)
                hashes.append(h)
                size += len(h)
        if ids:
            yield build()

    return run


def _passes(items: DataFrame, item_col: str, text_col: str, min_terms: int, block_terms: int, pass_bytes: int) -> Iterator[list[bytes]]:
    """The automata of all items, in lists of at most about `pass_bytes`."""
    rows = items.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    # A term takes two characters at least, with what parts it from the next.
    parts = max(1, -(-chars // (2 * block_terms)))
    built = rows.repartition(parts, F.xxhash64("i", "t")).mapInArrow(_building(min_terms, block_terms), "data binary, bytes bigint").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        now: list[bytes] = []
        size = 0
        for row in built.select("data", "bytes").toLocalIterator():
            if now and size + row["bytes"] > pass_bytes:
                yield now
                now, size = [], 0
            now.append(bytes(row["data"]))
            size += row["bytes"]
        if now:
            yield now
    finally:
        built.unpersist()


class _Automata:
    """Automata as they are shipped; each process opens them once."""

    def __init__(self, packed: list[bytes]):
        self._packed, self._opened = packed, None

    def __getstate__(self) -> list[bytes]:
        return self._packed

    def __setstate__(self, packed: list[bytes]) -> None:
        self._packed, self._opened = packed, None

    @property
    def opened(self) -> list[LeakIndex]:
        if self._opened is None:
            self._opened = [pickle.loads(x) for x in self._packed]
        return self._opened


def _scanner(spark: SparkSession, automata: list[bytes], item_type):
    shared = spark.sparkContext.broadcast(_Automata(automata))
    kind = to_arrow_type(item_type)

    @F.arrow_udf(f"struct<hits:array<struct<item:{item_type.simpleString()},longest:int,terms:int>>,spans:array<struct<char_from:int,chars:int,first:int,terms:int>>,terms:int>")
    def scan(text: pa.Array) -> pa.Array:
        rows: list[dict | None] = []
        for batch in small_batches([pa.RecordBatch.from_arrays([text], ["t"])], 0):
            low, places = zip(*(_lowered(t or "") for t in batch.column(0).to_pylist()))
            terms, found = Terms(list(low)), [None] * len(low)
            for index in shared.value.opened:
                index.scan(terms, found, places)
            rows += found
        for entry in rows:
            if entry:
                entry["hits"] = [{"item": i, "longest": a, "terms": b} for i, (a, b) in sorted(entry["hits"].items())]
        entry = pa.struct([("item", kind), ("longest", pa.int32()), ("terms", pa.int32())])
        span = pa.struct([("char_from", pa.int32()), ("chars", pa.int32()), ("first", pa.int32()), ("terms", pa.int32())])
        return pa.array(rows, pa.struct([("hits", pa.list_(entry)), ("spans", pa.list_(span)), ("terms", pa.int32())]))

    return scan


def _scans(documents: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, passage_col: str, min_terms: int, block_terms: int, pass_bytes: int) -> Iterator[DataFrame]:
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id is not null and _text is not null")
    for automata in _passes(items, item_col, passage_col, min_terms, block_terms, pass_bytes):
        yield docs.withColumn("_leak", _scanner(documents.sparkSession, automata, items.schema[item_col].dataType)(F.col("_text"))).where("_leak is not null")


def leaks(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", min_terms: int = 12, block_terms: int = 250_000, pass_bytes: int = 1 << 28) -> DataFrame:
    """(id_col, item_col, longest, covered): documents that hold at least `min_terms` consecutive terms of an item.

    longest is a length of a common run that is at least min_terms and exact wherever the item holds the document's longest match; covered counts the
    document's terms in runs of min_terms terms that the item holds.  Null ids and texts, and passages shorter than min_terms, are in no row.
    Rows repeated under one id are one result each, made distinct.  No items give an empty result.
    """
    out = None
    for part in _scans(documents, items, id_col, text_col, item_col, passage_col, min_terms, block_terms, pass_bytes):
        rows = part.select("_id", F.inline("_leak.hits")).select(F.col("_id").alias(id_col), F.col("item").alias(item_col), "longest", F.col("terms").alias("covered")).distinct()
        out = rows if out is None else out.unionByName(rows).distinct()
    if out is None:
        kinds = f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, `{item_col}` {items.schema[item_col].dataType.simpleString()}, longest int, covered int"
        return documents.sparkSession.createDataFrame([], kinds)
    return out


def remove_leaks(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", min_terms: int = 12, max_share: float = 0.5, block_terms: int = 250_000, pass_bytes: int = 1 << 28) -> DataFrame:
    """(id_col, clean_text, removed, dropped): every document that leaks, without the leaked spans; removed counts their terms.

    A document whose leaked spans cover more than `max_share` of its terms is dropped whole: clean_text is null.
    Documents that do not leak are in no row: they stay as they are.
    """
    out = None
    for part in _scans(documents, items, id_col, text_col, item_col, passage_col, min_terms, block_terms, pass_bytes):
        rows = part.select(F.col("_id"), F.col("_text"), F.col("_leak.spans").alias("spans"), F.col("_leak.terms").alias("terms"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return documents.where("false").select(F.col(id_col), F.col(text_col).alias("clean_text"), F.lit(0).cast("bigint").alias("removed"), F.lit(False).alias("dropped"))
    # Spans of several automata may overlap: a character, and a term, goes once.
    merged = out.groupBy("_id", "_text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.max("terms").alias("terms"))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"), F.lit(0).alias("term"), F.lit(0).cast("bigint").alias("gone"))
    step = lambda a, s: F.struct(
        F.concat(a["kept"], F.when(s["char_from"] > a["at"], F.substring(F.col("_text"), a["at"] + 1, s["char_from"] - a["at"])).otherwise(F.lit(""))).alias("kept"),
        F.greatest(a["at"], s["char_from"] + s["chars"]).alias("at"),
        F.greatest(a["term"], s["first"] + s["terms"]).alias("term"),
        (a["gone"] + F.greatest(F.lit(0), s["first"] + s["terms"] - F.greatest(a["term"], s["first"]))).alias("gone"),
    )
    folded = merged.withColumn("_f", F.aggregate("spans", start, step))
    dropped = F.col("_f.gone") > F.col("terms") * F.lit(max_share)
    text = F.when(~dropped, F.concat(F.col("_f.kept"), F.substring(F.col("_text"), F.col("_f.at") + 1, F.length("_text"))))
    return folded.select(F.col("_id").alias(id_col), text.alias("clean_text"), F.col("_f.gone").alias("removed"), dropped.alias("dropped"))
