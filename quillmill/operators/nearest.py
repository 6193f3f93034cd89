"""Nearest vectors by cosine similarity: blocks of vectors against blocks of queries.

Vectors are gathered into matrices by group, and a large group into several; queries into matrices of their own.  A block of queries meets
every block of vectors of its length (and, with an index, of the cells it asks for), and each meeting is one matrix product that keeps the k best rows of
each query.  A group that is one block needs no further step; of the others the best of all blocks are chosen.  Through the driver pass the vectors of queries
that are broadcast, no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmill.functions.vectors import as_double

#: Rows of a block of vectors, and of queries; bytes of query blocks that are broadcast at most (beyond, they are shuffled).
BLOCK_ROWS, QUERY_ROWS, BROADCAST_BYTES = 1 << 15, 1 << 10, 1 << 25


def _matrices(keys: int, id_type: pa.DataType, most: int):
    """Sorted rows (keys, id, vector) to (keys, dim, ids, matrix): unit vectors of equal keys and length, ids ascending, at most `most` rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        schema: list[pa.DataType] = []
        now: tuple | None = None
        open_: dict[int, tuple[list, list]] = {}

        def close(dim: int) -> pa.RecordBatch:
            ids, rows = open_.pop(dim)
            named = pa.array(ids, id_type)
            order = pc.sort_indices(named)
            m = np.concatenate(rows)[order.to_numpy()].astype(np.float64)
            length = np.sqrt((m * m).sum(axis=1, keepdims=True))
            m /= np.where(length > 0, length, 1.0)
            columns = [pa.array([k], t) for k, t in zip(now, schema)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([dim], pa.int32()), pa.array([named.take(order).to_pylist()], pa.list_(id_type)), pa.array([m.data], pa.binary())], [*names, "dim", "ids", "matrix"])

        for batch in batches:
            if not names:
                names, schema = batch.schema.names[:keys], [batch.schema.field(k).type for k in range(keys)]
            own = list(zip(*(batch.column(k).to_pylist() for k in range(keys))))
            ids, dims, flat = batch.column(keys).to_pylist(), pc.list_value_length(batch.column(keys + 1)).to_numpy().astype(np.int64), batch.column(keys + 1).flatten()
            first = np.cumsum(dims) - dims
            whole = np.ones(len(ids), dtype=bool)
            if flat.null_count:
                whole[np.repeat(np.arange(len(ids)), dims)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
            values = flat.to_numpy(zero_copy_only=False)
            for key, same in groupby(range(len(ids)), key=own.__getitem__):
                if key != now:
                    for dim in list(open_):
                        yield close(dim)
                    now = key
                at = np.array(list(same))
                at = at[whole[at]]
                for dim in map(int, np.unique(dims[at])):
                    alike = at[dims[at] == dim]
                    while len(alike):
                        held, vectors = open_.setdefault(dim, ([], []))
                        part, alike = np.split(alike, [most - len(held)])
                        held += [ids[i] for i in part]
                        vectors.append(values[first[part][:, None] + np.arange(dim)])
                        if len(held) >= most:
                            yield close(dim)
        for dim in list(open_):
            yield close(dim)

    return run


def _best_rows(sims: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest rounded values of each line: (line, place, value); ties go to the lower places."""
    lines, n = sims.shape
    if n > k:
        # A line's places are dealt to sets; the k-th largest of the maxima of sets is a value that at least k places reach.  Rounding moves none by as much as the last digit.
        sets = max(k, n // 64)
        most = sims[:, :sets].copy()
        for lo in range(sets, n - sets + 1, sets):
            np.fmax(most, sims[:, lo : lo + sets], out=most)
        most[np.isnan(most)] = -np.inf
        least = np.partition(most, sets - k, axis=1)[:, sets - k] - (0.0 if digits is None else 10.0**-digits)
        line, place = np.nonzero(sims >= least[:, None])
    else:
        line, place = (x.ravel() for x in np.indices(sims.shape))
    value = sims[line, place]
    value = (value if digits is None else np.round(value, digits)) + 0.0
    if n > k:
        order = np.lexsort((place, -value, line))
        first = np.searchsorted(line, np.arange(lines))
        order = order[np.arange(len(order)) - first[line] < k]
        line, place, value = line[order], place[order], value[order]
    return line, place, value


def _best_of_meetings(k: int, digits: int | None):
    """Rows (dim, ids, matrix, group, asked, questions) to the k best ids of each question and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                ids, asked = batch.column(1)[i].values, batch.column(4)[i].values
                m = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.float64).reshape(-1, dim)
                w = np.frombuffer(batch.column(5)[i].as_buffer(), dtype=np.float64).reshape(-1, dim)
                step = max(1, (1 << 20) // len(m))
                for at in range(0, len(w), step):
                    col, row, sims = _best_rows(w[at : at + step] @ m.T, k, digits)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(at + col)), ids.take(pa.array(row)), pa.repeat(batch.column(3)[i], len(row)), pa.array(sims)], ["_q", "_id", "_group", "similarity"])

    return run


def _meetings(matrices: Iterator[pa.RecordBatch], known: dict[tuple, list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Each matrix (_cell, _group, _salt, dim, ids, matrix) beside each block of questions of its cell and length, one after the other: it is not copied."""
    for batch in matrices:
        cell, group, _, dim, ids, matrix = batch.columns
        for questions in known.get((cell[0].as_py(), dim[0].as_py()), ()):
            yield pa.RecordBatch.from_arrays([dim, ids, matrix, group, *questions.columns], ["dim", "ids", "matrix", "_group", "asked", "questions"])


def _rows(df: DataFrame, id_col: str, vector_col: str, *more) -> DataFrame:
    # Single precision stays until it is computed with: it takes half the room.
    narrow = df.schema[vector_col].dataType.simpleString() == "array<float>"
    return df.select(*more, F.col(id_col).alias("_id"), (F.col(vector_col) if narrow else as_double(F.col(vector_col))).alias("_v")).where("_id is not null and size(_v) > 0")


def _top(vectors: DataFrame, queries: DataFrame, k: int, digits: int | None, cells: bool) -> DataFrame:
    """The k best (_q, _id, _group, similarity): vectors (_cell, _group, _id, _v), queries (_cell, _id, _v); with `cells` only equal ones meet."""
    spark = vectors.sparkSession
    id_type, q_type, group = vectors.schema["_id"].dataType, queries.schema["_id"].dataType, vectors.schema["_group"].dataType
    on = ["_cell", "_group"]
    # A group is cut into as many blocks as it has rows for.  Of groups with more rows than a block there are few, so they are broadcast and no vector moves for it.
    large = vectors.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK_ROWS).select(F.col("_cell").alias("_c"), F.col("_group").alias("_g"), F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_many"))
    met = vectors.join(F.broadcast(large), F.col("_cell").eqNullSafe(F.col("_c")) & F.col("_group").eqNullSafe(F.col("_g")), "left")
    placed = met.withColumn("_parts", F.coalesce("_many", F.lit(1))).withColumn("_salt", F.pmod(F.hash("_id"), F.col("_parts")))
    keys = ["_cell", "_group", "_salt"]
    kinds = lambda cols, df: ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)
    tail = lambda t: f"dim int, ids array<{t.simpleString()}>, matrix binary"
    size = queries.agg(F.sum(8 * F.size("_v") + 16)).first()[0] or 0
    few = size <= BROADCAST_BYTES
    asked = queries.select("_cell", "_id", "_v")
    if few or cells:
        asked = (asked.repartition(1) if few else asked.repartition("_cell")).sortWithinPartitions("_cell")
    questions = asked.mapInArrow(_matrices(1, to_arrow_type(q_type), QUERY_ROWS), f"_cell int, {tail(q_type)}").select("_cell", "dim", F.col("ids").alias("asked"), F.col("matrix").alias("questions"))
    meet = ["_cell", "dim"]
    out = f"_q {q_type.simpleString()}, _id {id_type.simpleString()}, _group {group.simpleString()}, similarity double"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # By chance of the hash a part may hold more than its share; whole parts hold no more than a block.
    matrices, best = _matrices(3, to_arrow_type(id_type), 2 * BLOCK_ROWS), _best_of_meetings(k, digits)
    if few:
        known: dict[tuple, list[pa.RecordBatch]] = {}
        for r in questions.collect():  # BROADCAST_BYTES at most
            known.setdefault((r["_cell"], r["dim"]), []).append(pa.RecordBatch.from_arrays([pa.array([r.asked], pa.list_(to_arrow_type(q_type))), pa.array([bytes(r.questions)], pa.binary())], ["asked", "questions"]))
        sent = spark.sparkContext.broadcast(known)

    def found(rows: DataFrame) -> DataFrame:
        lying = rows.select(*keys, "_id", "_v").repartition("_cell", "_group", "_salt").sortWithinPartitions(*keys)
        if few:
            return lying.mapInArrow(lambda batches: best(_meetings(matrices(batches), sent.value)), out)
        blocks = lying.mapInArrow(matrices, f"{kinds(keys, lying)}, {tail(id_type)}").select("_cell", "dim", "ids", "matrix", "_group")
        # Blocks of vectors stay apart by salt; each block of questions goes to every salt.
        met = blocks.withColumn("_p", F.pmod(F.xxhash64("_group", "ids"), F.lit(width))).join(questions.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))), [*meet, "_p"])
        return met.select("dim", "ids", "matrix", "_group", "asked", "questions").mapInArrow(best, out)

    if cells:
        return _best(found(placed), k)
    return found(placed.where("_parts = 1")).unionByName(_best(found(placed.where("_parts > 1")), k))


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("_q", "_group").orderBy(F.desc("similarity"), F.asc("_id")))
    return found.withColumn("_rank", place).where(F.col("_rank") <= k).drop("_rank")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str, vector_col: str, query_id: str = "query_id", query_vector: str = "query_vector", collection: str | None = None, digits: int | None = 6) -> DataFrame:
    """The k nearest vectors by cosine similarity, exactly, for each query (and collection).

    Ties go to the lower id.  Null and empty vectors, vectors that hold a null and vectors of another length than the query's match nothing; a zero vector has
    similarity 0.  Rows without a collection are one group of their own.  Ids should be unique.
    """
    group = F.col(collection) if collection else F.lit(None).cast("string")
    base = _rows(vectors, id_col, vector_col, F.lit(0).alias("_cell"), group.alias("_group"))
    best = _top(base, _rows(queries, query_id, query_vector, F.lit(0).alias("_cell")), k, digits, cells=False)
    return best.select(F.col("_q").alias(query_id), F.col("_id").alias(id_col), *([F.col("_group").alias(collection)] if collection else []), "similarity")


class VectorIndex:
    """An inverted file over unit vectors: cells around centroids, of which a query visits the `probes` nearest.

    Centroids are fitted on a bounded sample (`sample` rows, spherical k-means); every vector is in the index, in the cell of its nearest centroid.  What a visited
    cell holds is compared exactly; dense_topk is the exact way for all.
    """

    def __init__(self, vectors: DataFrame, *, id_col: str, vector_col: str, cells: int = 64, sample: int = 20_000, seed: int = 1, rounds: int = 12):
        self.id_col = id_col
        rows = _rows(vectors, id_col, vector_col)
        drawn = np.array([r[0] for r in rows.orderBy(F.xxhash64("_id", F.lit(seed))).select("_v").limit(sample).collect()], dtype=np.float64)  # at most `sample` rows
        self.centroids = self._fit(drawn, cells, seed, rounds) if len(drawn) else np.zeros((0, 0))
        self.vectors = self._in_cells(rows, 1).withColumn("_group", F.lit(None).cast("string"))

    @staticmethod
    def _fit(rows: np.ndarray, cells: int, seed: int, rounds: int) -> np.ndarray:
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
        rows = unit(rows)
        r = np.random.default_rng(seed)
        centers = rows[r.choice(len(rows), min(cells, len(rows)), replace=False)]
        for _ in range(rounds):
            near = (rows @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, near, rows)
            held = np.bincount(near, minlength=len(centers)) > 0
            centers[held] = unit(sums[held])
        return centers

    def _in_cells(self, rows: DataFrame, probes: int) -> DataFrame:
        """(_cell, _id, _v): a row for each of the `probes` nearest cells."""
        centers = rows.sparkSession.sparkContext.broadcast(self.centroids)  # `cells` rows
        kind, vector = (rows.schema[c].dataType.simpleString() for c in ("_id", "_v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centers.value
            for batch in batches:
                vectors = batch.column(1).to_pylist()
                fit = [i for i, v in enumerate(vectors) if c.size and len(v) == c.shape[1] and None not in v]
                if not fit:
                    continue
                near = np.argsort(-(np.array([vectors[i] for i in fit]) @ c.T), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.array(fit), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], ["_cell", "_id", "_v"])

        return rows.mapInArrow(run, f"_cell int, _id {kind}, _v {vector}")

    def topk(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query_vector: str = "query_vector", probes: int = 16, digits: int | None = 6) -> DataFrame:
        """The k nearest vectors in the cells that each query visits; vectors of another length than the sample's are in no cell."""
        asked = self._in_cells(_rows(queries, query_id, query_vector), probes)
        best = _top(self.vectors.select("_cell", "_group", "_id", "_v"), asked, k, digits, cells=True)
        return best.select(F.col("_q").alias(query_id), F.col("_id").alias(self.id_col), "similarity")
