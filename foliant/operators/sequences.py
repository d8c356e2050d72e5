"""Sequential takes and samples (O-05 .. O-09, W-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.runs import Runs


def even_sample(rows: DataFrame, key: str, order: str, count: int) -> DataFrame:
    """O-07, H-02: the ``count`` evenly spaced rows of each key, the first for a
    count of 1; (key, order, k)."""
    r = Runs(rows.select(key, order), [key], [order]).total("k", F.lit(1)).count("total").table()
    r = r.withColumn("k", (F.col("k") - 1).cast("long"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("total") - 1) / F.lit(float(max(count - 1, 1))) + 0.5))
    return r.where(F.array_contains(wanted, F.col("k"))).select(key, order, "k")


def first_middle_last(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """O-06: at most three rows of each key: first, middle, last."""
    w = W.partitionBy(key)
    r = rows.withColumn("k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count("*").over(w))
    return r.where((F.col("k") == 0) | (F.col("k") == F.floor((F.col("total") - 1) / 2)) | (F.col("k") == F.col("total") - 1)).select(key, F.col("k").cast("long").alias("k"), value)
