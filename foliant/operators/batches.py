"""Bounds of what one task and one Python worker hold, however large a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bounds what an Arrow batch of whole texts can hold in a Python worker.
    These two settings of the session are lowered, never raised."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def pieces(spark: SparkSession, rows: int, most: int = 1 << 19) -> int:
    """Partitions of about ``most`` of ``rows`` rows, no fewer than the session
    would make: what a task holds doesn't grow with a table, and few bytes that
    become long texts aren't put together in one task."""
    return max(-(-rows // most), spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def met(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose rows are shuffled and met in order.  The
    engine takes the size of a written table for that of its files; keys of millions
    of rows that are alike take few bytes there and would go through the driver."""
    return df.hint("merge")
