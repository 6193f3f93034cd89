"""Folding a DataFrame into one vector of fixed size.

Every task folds its rows into one vector; the vectors are then merged in two
more rounds, each task streaming over the vectors it gets and holding one.  The
driver receives one vector, whose size does not depend on the data.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Shipped:
    """A vector made small for shipping; each process opens it once."""

    def __init__(self, vector: np.ndarray):
        self._data, self._dtype = zlib.compress(vector.tobytes(), 6), vector.dtype.str
        self._open: np.ndarray | None = None

    def __getstate__(self) -> tuple[bytes, str]:
        return self._data, self._dtype

    def __setstate__(self, state: tuple[bytes, str]) -> None:
        self._data, self._dtype = state
        self._open = None

    @property
    def vector(self) -> np.ndarray:
        if self._open is None:
            self._open = np.frombuffer(zlib.decompress(self._data), dtype=self._dtype)
        return self._open


def _packed(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["vector"])


def _opened(raw: bytes, size: int, dtype: str, narrow: type) -> np.ndarray:
    """A packed vector, written in `dtype` or, if it is shorter, in the narrower type."""
    data = zlib.decompress(raw)
    return np.frombuffer(data, dtype=dtype if len(data) == size * np.dtype(dtype).itemsize else narrow)


def _merger(size: int, dtype: str, merge: str, narrow: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size, dtype=dtype), False
        for batch in batches:
            for row in batch.column(0):
                getattr(np, merge)(total, _opened(row.as_py(), size, dtype, narrow), out=total)
                any_rows = True
        if any_rows:
            small = total.astype(narrow) if narrow is not np.dtype(dtype).type and total.max(initial=0) <= np.iinfo(narrow).max else total
            yield _packed(small)

    return run


def _merged(parts: DataFrame, size: int, dtype: str, merge: str, narrow: type) -> np.ndarray:
    """The vectors of all tasks merged in two more rounds; one of them, of fixed size, reaches the driver."""
    width = parts.sparkSession.sparkContext.defaultParallelism
    merger = _merger(size, dtype, merge, narrow)
    middle = parts.repartition(max(1, min(width, math.isqrt(max(1, width)) * 2))).mapInArrow(merger, "vector binary")
    rows = middle.repartition(1).mapInArrow(merger, "vector binary").collect()  # one row, or none for an empty input
    return _opened(bytes(rows[0].vector), size, dtype, narrow) if rows else np.zeros(size, dtype=dtype)


def fold_counts(df: DataFrame, size: int, cells_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often each of `size` cells is named by cells_of(batch) over all batches of `df` (int64).

    Tasks count in 32 bits; as no task names one cell 2^31 times, sums are taken in 64 bits where vectors meet.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size, dtype=np.int32), False
        for batch in batches:
            if batch.num_rows:
                np.add.at(total, cells_of(batch), 1)
                any_rows = True
        if any_rows:
            yield _packed(total)

    return _merged(df.mapInArrow(fold, "vector binary"), size, "int64", "add", np.int32)


def fold_vectors(df: DataFrame, size: int, vector_of: Callable[[pa.RecordBatch], np.ndarray], *, dtype: str = "int64", merge: str = "add") -> np.ndarray:
    """Merge vector_of(batch), of `size` and `dtype`, over all batches of `df`; zeros for no rows.

    `merge` names a binary numpy function for which 0 is neutral, such as add or maximum.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size, dtype=dtype), False
        for batch in batches:
            if batch.num_rows:
                getattr(np, merge)(total, vector_of(batch).astype(dtype), out=total)
                any_rows = True
        if any_rows:
            yield _packed(total)

    return _merged(df.mapInArrow(fold, "vector binary"), size, dtype, merge, np.dtype(dtype).type)
