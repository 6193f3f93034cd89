"""Work for every core where a table lies in fewer pieces than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame) -> DataFrame:
    """A table as read, in as many partitions as there are cores if it has fewer; a large table has more and stays as it is.

    For work that costs far more than moving the rows once, such as passes over whole texts.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
