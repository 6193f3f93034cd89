"""Joins on keys of which some may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.lineage import cut

#: Rows of one key that a task may hold, and how many keys at most are split (the bound of what is broadcast).
KEY_ROWS, MOST_KEYS = 200_000, 10_000


def hot_keys(rows: DataFrame, key: str, total: int, key_rows: int | None = None) -> DataFrame:
    """(key, _parts): keys with more rows than a task should hold, and over how many parts each is to be spread.

    `total` is the number of rows; no more than MOST_KEYS keys can pass the limit.
    """
    limit = max(KEY_ROWS if key_rows is None else key_rows, total // MOST_KEYS)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))


def salted_join(rows: DataFrame, other: DataFrame, key: str, spread: str, total: int, *, counted: DataFrame | None = None, key_rows: int | None = None) -> DataFrame:
    """rows JOIN other USING (key); hot keys of `rows` are spread by column `spread`, and what they join is repeated for each part.

    Keys are counted in `counted`, materialised rows of which `rows` are some or all, with `total` rows; `rows` itself unless it is given.
    """
    if total <= (KEY_ROWS if key_rows is None else key_rows):
        return rows.join(other, key)  # no key can be hot
    hot = hot_keys(rows if counted is None else counted, key, total, key_rows).persist()
    if not hot.count():
        return rows.join(other, key)
    if counted is not None:
        rows = cut(rows)  # read twice
    # Only rows of hot keys are moved by key and part; all others join as they lie.  At most MOST_KEYS keys are broadcast.
    named = F.broadcast(hot.select(key))
    cold = rows.join(named, key, "left_anti").join(other, key)
    salted = rows.join(F.broadcast(hot), key).withColumn("_salt", F.pmod(F.hash(spread), F.col("_parts"))).drop("_parts")
    repeated = other.join(F.broadcast(hot), key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return cold.unionByName(salted.join(repeated, [key, "_salt"]).drop("_salt"))
