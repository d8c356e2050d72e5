"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import re
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_found: dict[str, dict[str, tuple]] = {}
FIXTURES: dict[str, tuple] = {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its own name."""

    def put(f):
        _found.setdefault(f.__module__, {})[f.__name__] = (f, sql)
        return f

    return put


def fixture(sql: str):
    """Keeps a function that reads an inline table and its answer for the tests
    only: what is registered reads the given tables."""

    def put(f):
        FIXTURES[f.__name__] = (f, sql)
        return f

    return put


def oracle(module: str) -> tuple[dict, dict]:
    """(queries, oracle SQL) of a module; a query without SQL has no entry."""
    got = _found.get(sys.modules[module].__name__, {})
    return {k: f for k, (f, _) in got.items()}, {k: s for k, (_, s) in got.items() if s}


def read(spark: SparkSession, sf_dir: str, name: str, *columns) -> DataFrame:
    """A table; texts that lie in so few pieces that three of four cores would be
    idle are dealt out, as those of a small file of one row group.  Larger inputs
    have more pieces and don't move."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return dealt(df) if name == "documents" and "text" in df.columns else df


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt out if it lies in so few pieces."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return df.repartition(cores) if pieces * 4 <= cores else df


#: The given tables.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def derived(spark: SparkSession, sf_dir: str, sql: str, deal: str | None = None) -> DataFrame:
    """Rows of a statement over the given tables that the oracle reads as well.  The
    rows of the table ``deal`` are dealt out if few pieces hold them, for statements
    that make long texts of short rows."""
    if deal:
        view = f"{deal}_{uuid.uuid4().hex}"
        dealt(read(spark, sf_dir, deal)).createOrReplaceTempView(view)
        sql = re.sub(rf"\b(FROM|JOIN) {deal}\b", rf"\1 {view} AS {deal}", sql)
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet` AS \2", sql))


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """An inline table; ``rows`` is the text of the oracle's VALUES list too."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")
