"""Event-time windows over a stream or a table: an extension of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, time_col: str = "ts", key: str = "event_type", size: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events and their value per key and window; on a stream, later than `lateness` is dropped."""
    timed = events.withWatermark(time_col, lateness) if events.isStreaming else events
    return timed.groupBy(F.window(time_col, size).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
