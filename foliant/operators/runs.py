"""Running totals, numbers and neighbours over ordered rows of which one key may
hold most.

Rows are ordered once into range partitions by key and order and written.  A run
is what a partition holds of a key; totals and neighbours are computed inside runs
and carried on by one row a run, of keys in more than one run only: at most two a
partition, which are broadcast.  No window holds more than a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.sources.stage import staged


class Runs:
    """``rows`` in range partitions by ``key`` and ``order``, as ``rows`` with
    _run.  Null keys are keys like others."""

    def __init__(self, rows: DataFrame, key: list[str], order: list[str]) -> None:
        self.key, self.order = key, order
        ranged = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
        self.rows = staged(ranged.withColumn("_run", F.spark_partition_id()))
        self.columns = rows.columns

    def _inside(self):
        return W.partitionBy("_run", *self.key).orderBy(*self.order)

    def _carried(self, *made: Column) -> DataFrame:
        """A row (_run, key, ...) for each run of keys that have several."""
        by = self.rows.groupBy("_run", *self.key).agg(*made)
        return by.withColumn("_runs", F.count("*").over(W.partitionBy(*self.key))).where("_runs > 1").drop("_runs")

    def _joined(self, carried: DataFrame, columns: list[str]) -> DataFrame:
        small = F.broadcast(carried.select(F.col("_run").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)), *columns))
        on = F.col("_run") == F.col("_r")
        for i, k in enumerate(self.key):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return self.rows.join(small, on, "left").drop("_r", *(f"_k{i}" for i in range(len(self.key))))

    def total(self, name: str, value: Column) -> Runs:
        """Adds ``name``, the total of ``value`` up to a row, itself included."""
        ahead = self._carried(F.sum(value).alias("_s"))
        ahead = ahead.withColumn("_ahead", F.sum("_s").over(W.partitionBy(*self.key).orderBy("_run")) - F.col("_s"))
        inside = F.sum(value).over(self._inside().rowsBetween(W.unboundedPreceding, 0))
        self.rows = self._joined(ahead, ["_ahead"]).withColumn(name, F.coalesce("_ahead", F.lit(0)) + inside).drop("_ahead")
        self.columns.append(name)
        return self

    def count(self, name: str) -> Runs:
        """Adds ``name``, the number of rows of a row's key."""
        all_ = self._carried(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(W.partitionBy(*self.key)))
        own = F.count("*").over(W.partitionBy("_run", *self.key))
        self.rows = self._joined(all_, ["_all"]).withColumn(name, F.coalesce("_all", own)).drop("_all")
        self.columns.append(name)
        return self

    def neighbours(self, value: str, before: str, after: str) -> Runs:
        """Adds ``before`` and ``after``, a column of the rows beside a row."""
        ends = self._carried(F.max_by(value, F.struct(*self.order)).alias("_last"), F.min_by(value, F.struct(*self.order)).alias("_first"))
        w = W.partitionBy(*self.key).orderBy("_run")
        ends = ends.withColumns({"_b": F.lag("_last").over(w), "_a": F.lead("_first").over(w)})
        inside = self._inside()
        edge = {"_one": F.row_number().over(inside) == 1, "_end": F.lead(F.lit(1)).over(inside).isNull()}
        near = {before: F.when(F.col("_one"), F.col("_b")).otherwise(F.lag(value).over(inside)), after: F.when(F.col("_end"), F.col("_a")).otherwise(F.lead(value).over(inside))}
        self.rows = self._joined(ends, ["_b", "_a"]).withColumns(edge).withColumns(near).drop("_b", "_a", "_one", "_end")
        self.columns += [before, after]
        return self

    def table(self) -> DataFrame:
        return self.rows.select(*self.columns)
