"""Vectorised term and shingle hashing for whole Arrow batches of texts.

A *term* is a maximal run of letters and digits of the lower-cased text.  One
call handles all texts of a batch with a fixed number of numpy passes, so the
cost per character stays far below that of a regular expression per text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def _alnum_table() -> np.ndarray:
    """True for the code points that Python counts as letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


def runs_of(lengths: Iterable[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose lengths sum up to `most` or that are one item."""
    lo = total = hi = 0
    for hi, n in enumerate(lengths, 1):
        if total and total + n > most:
            yield lo, hi - 1
            lo, total = hi - 1, 0
        total += n
    if hi > lo:
        yield lo, hi


def small_batches(batches: Iterable[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most about `most` bytes in a string or binary column, so that memory stays flat."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for lo, hi in runs_of(lengths, most):
            yield batch.slice(lo, hi - lo)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads weak low bits over the whole word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = str(int(base))
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[key] = np.multiply.accumulate(step)
    return have[:n]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one NUL, and where each text starts."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    raw = ("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass") if texts else b""
    return np.frombuffer(raw, dtype=np.uint32), starts


class Terms:
    """Terms of a batch: hash, owner (row in the batch) and span in the joined text."""

    __slots__ = ("count", "end", "first", "hash", "owner", "start", "text_start")

    def __init__(self, texts: list[str]):
        codes, text_start = codes_of(texts)
        self.text_start = text_start
        alnum = _alnum_table()[codes]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], alnum, [False]]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = span_hash(codes, self.start, self.end)
        self.owner = np.searchsorted(text_start, self.start, side="right") - 1
        self.count = np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1]


#: Code points hashed at once; it bounds the table of powers.
_BLOCK = 1 << 20


def span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for sorted, disjoint spans (polynomial, then mixed)."""
    out = np.zeros(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = int(np.searchsorted(end, base + _BLOCK, side="right"))
        to = max(to, at + 1)
        s, e = start[at:to] - base, end[at:to] - base
        part = codes[base : base + e[-1]].astype(np.uint64) + np.uint64(1)
        n = len(part)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(part * _powers(_BASE, n), dtype=np.uint64)])
            out[at:to] = (total[e] - total[s]) * _powers(_INV, n + 1)[s] + (e - s).astype(np.uint64)
        at = to
    return mix64(out)


def shingle_hashes(terms: Terms, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` consecutive terms and the row that owns each."""
    h, n = terms.hash, len(terms.hash) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        acc = h[:n].copy()
        for k in range(1, width):
            acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n])
    whole = terms.owner[:n] == terms.owner[width - 1 : width - 1 + n]
    return mix64(acc[whole]), terms.owner[:n][whole]


def distinct_by_owner(values: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each owner, sorted; returns (values, owner, offsets by owner)."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    if len(v):
        keep = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])
        v, o = v[keep], o[keep]
    return v, o, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=rows))]).astype(np.int64)
