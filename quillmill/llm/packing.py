"""Filling containers of fixed capacity: shortest-pack-first over the length histogram.

Only the histogram of lengths (at most `capacity` cells) reaches the driver.  Lengths are placed longest first;
each goes to the open pattern with the least content, patterns counted in bulk.  Items then find their
container by their rank among the items of their length.
"""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.tokens import token_counts
from quillmill.plans.lineage import cut
from quillmill.plans.ordered import running_totals


@dataclass
class Plan:
    """Which container each item goes to: item g (by length, then rank) lies in the slot run that holds g."""

    base: np.ndarray  # by length: items of lesser length
    start: np.ndarray  # first item of each slot run
    container: np.ndarray  # first container of each slot run
    repeat: np.ndarray  # items of that length in each container of the run
    containers: int

    def of(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        item = self.base[length] + rank
        run = np.searchsorted(self.start, item, side="right") - 1
        return self.container[run] + (item - self.start[run]) // self.repeat[run]


def plan_packing(histogram: np.ndarray, capacity: int) -> Plan:
    """Packing patterns for histogram[length] items of each length 1 .. capacity.

    Each length makes at most three more patterns (one split, two new), and a pattern has fewer than
    sqrt(2 * capacity) different lengths, so the plan's size depends on the capacity alone.
    """
    tick = itertools.count()
    open_: list[tuple[int, int, int, tuple]] = []  # (content, tie, how many, ((length, times), ...))
    for length in range(min(capacity, len(histogram) - 1), 0, -1):
        left = int(histogram[length])
        while left and open_ and open_[0][0] + length <= capacity:
            content, _, many, parts = heapq.heappop(open_)
            take = min(many, left)
            if take < many:
                heapq.heappush(open_, (content, next(tick), many - take, parts))
            left -= take
            grown = (*parts[:-1], (length, parts[-1][1] + 1)) if parts[-1][0] == length else (*parts, (length, 1))
            heapq.heappush(open_, (content + length, next(tick), take, grown))
        # What is left opens new containers, each with as many of this length as it holds: a hot length fills its own.
        full, rest = divmod(left, capacity // length)
        for times, many in ((capacity // length, full), (rest, 1)):
            if times and many:
                heapq.heappush(open_, (length * times, next(tick), many, ((length, times),)))
    done = [(many, parts) for _, _, many, parts in open_]
    base = np.concatenate([[0], np.cumsum(histogram)])[: len(histogram)].astype(np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for many, parts in done:
        for length, times in parts:
            runs.setdefault(length, []).append((many * times, first, times))
        first += many
    start, container, repeat = [], [], []
    for length in sorted(runs):
        at = int(base[length])
        for items, where, times in runs[length]:
            start.append(at)
            container.append(where)
            repeat.append(times)
            at += items
    as64 = lambda x: np.array(x, dtype=np.int64)
    return Plan(base, as64(start), as64(container), as64(repeat), first)


def pack(items: DataFrame, id_cols: list[str], length_col: str, capacity: int) -> DataFrame:
    """Add `container` (0, 1, ...) to narrow rows with lengths 1 .. capacity; others get null.

    Items are ranked among those of equal length by `id_cols`; rows equal in these get places of their own, in any order.
    """
    fits = items.where(F.col(length_col).between(1, capacity)).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(fits, [length_col], id_cols, {"_rank": "_one"})
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in ranked.groupBy(length_col).agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        histogram[row[0]] = row[1]
    plan = items.sparkSession.sparkContext.broadcast(plan_packing(histogram, capacity))

    @F.arrow_udf("bigint")
    def container(length: pa.Array, rank: pa.Array) -> pa.Array:
        numbers = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, rank)]
        return pa.array(plan.value.of(*numbers), pa.int64())

    packed = ranked.withColumn("container", container(F.col(length_col), F.col("_rank"))).select(*items.columns, "container")
    other = items.where(~F.coalesce(F.col(length_col).between(1, capacity), F.lit(False))).withColumn("container", F.lit(None).cast("bigint"))
    return packed.unionByName(other)


def pack_texts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_file: str | None = None) -> DataFrame:
    """(id_col, part_no, first_token, tokens, container) for all texts that are not blank.

    A text is divided only if it alone exceeds the capacity, into full parts and one rest.  Null and blank texts and null ids are
    left out; rows repeated under one id are packed each.  `tokenizer_file` names a rank file of a public byte-level BPE.
    """
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).where(F.col(id_col).isNotNull())
    counted = rows.select(id_col, token_counts(F.col("_text"), tokenizer_file).alias("_n")).where("_n > 0")
    parts = counted.select(id_col, "_n", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / capacity).cast("int"))).alias("part_no"))
    narrow = parts.select(id_col, "part_no", (F.col("part_no") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("_n") - F.col("part_no") * capacity).cast("int").alias("tokens"))
    # Written once: sorting and placing would each count the tokens anew.
    return pack(cut(narrow), [id_col, "part_no"], "tokens", capacity)
