"""Ingestion state as an append-only event log and views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["file_path", "file_hash"]


def latest_state(events: DataFrame, order: tuple[str, ...] = ("last_attempt", "attempt_count")) -> DataFrame:
    """The last event of each file version.

    Later means later in `order`, nulls first; ties go to done, then failed, then processing, then to the larger row.  An aggregate
    with map-side combine: a key with very many events is no group in one task.
    """
    weight = F.when(F.col("status") == "done", 3).when(F.col("status") == "failed", 2).when(F.col("status") == "processing", 1).otherwise(0)
    rest = [c for c in events.columns if c not in (*KEY, *order, "status")]
    best = F.max(F.struct(*order, weight.alias("_w"), "status", *rest)).alias("_s")
    return events.groupBy(*KEY).agg(best).select(*KEY, *(F.col(f"_s.{c}").alias(c) for c in events.columns if c not in KEY))


def not_ingested(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose content hash is not done under any path."""
    done = state.where("status = 'done'").select("file_hash").distinct()
    return files.join(done, "file_hash", "left_anti")


def failed_for_retry(state: DataFrame, max_retries: int = 3) -> DataFrame:
    return state.where((F.col("status") == "failed") & (F.col("attempt_count") < max_retries)).select(*KEY, "attempt_count")


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def collection_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"))


def total_records(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("records"))


def backoff_seconds(attempt: int) -> int:
    return 2**attempt


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`existing` with the rows of `incoming` put in by key; of several incoming rows the first in `order` counts.

    Incoming rows with a null key are left out.
    """
    once = incoming.dropna(subset=keys).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    return existing.join(once.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(once.select(*existing.columns))
