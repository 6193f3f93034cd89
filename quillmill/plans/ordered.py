"""Running totals within keys over globally sorted rows, safe for hot keys.

A window function sends each key to one task.  Here the rows are range-partitioned by
(keys, order), so that a hot key spreads over as many tasks as its rows need; each task
adds up its own stretch, and the totals of earlier stretches of the same key come from a
table with at most two rows for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.plans.lineage import cut


def _same_as_before(column: pa.Array) -> np.ndarray:
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    equal = pc.fill_null(pc.equal(now, before), False)
    return pc.or_(equal, pc.and_(pc.is_null(now), pc.is_null(before))).to_numpy(zero_copy_only=False)


def _stretches(keys: list[str], weights: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        carry = [0] * len(weights)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            fresh = np.ones(n, dtype=bool)
            if n > 1:
                same = np.ones(n - 1, dtype=bool)
                for c in columns:
                    same &= _same_as_before(c)
                fresh[1:] = ~same
            first = tuple(c[0].as_py() for c in columns)
            fresh[0] = last is None or first != last
            last = tuple(c[n - 1].as_py() for c in columns)
            group = np.cumsum(fresh) - 1  # -1: goes on from the batch before
            starts = np.flatnonzero(fresh)
            sums = []
            for j, w in enumerate(weights):
                value = batch.column(batch.schema.get_field_index(w)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(value)
                base = np.concatenate([(total[starts] - value[starts]), [-carry[j]]])
                sums.append(total - value - base[group])
                carry[j] = int(sums[-1][-1] + value[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), *(pa.array(s, pa.int64()) for s in sums)], [*batch.schema.names, "_part", *(f"_sum{j}" for j in range(len(sums)))])

    return run


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Add, for each new column name -> weight column, the sum of the weights of all earlier rows of the same keys.

    `keys` and `order` should name every row uniquely; rows equal in all of them come in any order among
    themselves.  Null keys are one group; weights must be non-null integers.  Pass narrow rows: they are written once to the checkpoint
    folder, because a range partitioning computed again may draw other borders.
    """
    keys, order = list(keys), list(order)
    ranged = df.repartitionByRange(partitions, *keys, *order) if partitions else df.repartitionByRange(*keys, *order)
    names, weights = list(totals), list(totals.values())
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), *(T.StructField(f"_sum{j}", T.LongType()) for j in range(len(names)))])
    local = cut(ranged.sortWithinPartitions(*keys, *order).mapInArrow(_stretches(keys, weights), schema))
    stretch = local.groupBy("_part", *keys).agg(*(F.sum(w).alias(f"_w{j}") for j, w in enumerate(weights)))
    spans = Window.partitionBy(*keys)
    before = spans.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that cross a border stay: at most two rows for each partition, hence the broadcast.
    offsets = stretch.withColumn("_n", F.count(F.lit(1)).over(spans)).select("*", *(F.coalesce(F.sum(f"_w{j}").over(before), F.lit(0)).alias(f"_off{j}") for j in range(len(names)))).where("_n > 1")
    offsets = offsets.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(f"_off{j}" for j in range(len(names))))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(F.broadcast(offsets), on, "left")
    return joined.select(*df.columns, *((F.col(f"_sum{j}") + F.coalesce(F.col(f"_off{j}"), F.lit(0))).alias(name) for j, name in enumerate(names)))
