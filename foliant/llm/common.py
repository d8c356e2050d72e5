"""Shared pieces of the training-data operators: table access, durable
intermediate tables, connected components and tree-merged task summaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS_CLASS = "[\\x20\\x09-\\x0D]"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table; texts that lie in so few pieces that three of four cores would be
    idle are dealt out, as those of a small file of one row group.  Larger inputs
    have more pieces and don't move.  The pieces with rows are counted without
    reading a column."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    if "text" not in df.columns:
        return df
    cores = spark.sparkContext.defaultParallelism
    pieces = df.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return df.repartition(cores) if pieces * 4 <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).  Where the session
    names none, a local one in local mode, which has one machine, and an error on
    a cluster, whose executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints/foliant"
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bounds what an Arrow batch of whole texts can hold in a Python worker.
    These two settings of the session are lowered, never raised."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def durable(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and
    no result is recomputed when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._durable_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes durable tables that no later read depends on: what was made from
    them has been written itself.  Other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "_durable_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WS_CLASS + "+"))).cast("long")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table.

    Returns (id, comp): every vertex of an edge with the smallest vertex id of
    its component.  Alternates the large-star and small-star contractions until
    the edges stop changing; both are a grouped minimum and an equi-join, so a
    hub vertex is pre-aggregated and its join can be split by AQE.  Each round
    is written to the shared folder and the one before deleted; ``release`` of the
    result deletes the last.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = mark(e)
    while last[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old = e
        e = durable(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        release(old, large)
        now = mark(e)
        if now == last:
            break
        last = now
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    out = stars.union(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
    out._durable_path = e._durable_path
    return out


def merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes], width: int = 16) -> bytes | None:
    """Reduces one ``blob`` row per task to a single blob in a tree.

    ``parts`` has (part int, blob binary), one row a task, each of bounded size.
    ``width`` blobs at a time are merged by executors until no more than that
    are left, so neither a task nor the driver ever holds more.
    """
    left = parts.rdd.getNumPartitions()

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // width], "blob": [merge(list(pdf["blob"]))]})

    while left > width:
        parts = parts.groupBy(F.floor(F.col("part") / width).alias("g")).applyInPandas(level, "part int, blob binary")
        left = -(-left // width)
    got = parts.select("blob").collect()
    return merge([bytes(r[0]) for r in got]) if got else None


def hash_sample(df: DataFrame, n: int, key: str, by: str | None = None) -> DataFrame:
    """About ``n`` rows of different ``key``, of each value of ``by`` if given,
    those of lowest hash: a bounded sample to fit on, the same in every run.  Of
    several rows with one key the least is taken."""
    top = float(1 << 63)
    h = F.xxhash64(key)
    share = F.lit(2.0 * n * top) / F.greatest(F.approx_count_distinct(h), F.lit(1)) - top
    if by is None:
        rows = df.where(h <= F.lit(df.agg(share).first()[0]))
    else:
        cuts = df.groupBy(F.col(by).alias("_by")).agg(share.alias("_cut"))
        rows = df.join(cuts, F.col(by).eqNullSafe(F.col("_by"))).where(h <= F.col("_cut")).select(df.columns)
    rest = [c for c in df.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*").select(df.columns)
