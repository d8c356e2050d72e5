"""Tables between the steps of a long job: written to the folder that all
executors share and read back, so that lineage is cut and a step isn't run again
for each table made from it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, which has one machine, a local folder
    where the session names none, and on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints/foliant"
    return found.rstrip("/")


#: Whether shuffle files go when an execution ends; else they lie until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: for writes, which nobody runs again."""
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def staged(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written, in folders by the columns ``by``, and read back."""
    path = f"{shared_dir(df.sparkSession)}/foliant-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def get_json(spark: SparkSession, path: str):
    """The value of a small JSON file of any store that Spark reaches, None where
    there is no such file."""
    where, fs = _place(spark, path)
    if not fs.exists(where):
        return None
    got = fs.open(where)
    try:
        return json.loads(bytes(got.readAllBytes()).decode())
    finally:
        got.close()


def put_json(spark: SparkSession, path: str, value) -> None:
    """Writes a small JSON file under another name and renames it, so that it is
    there whole or not at all."""
    where, fs = _place(spark, path)
    part, _ = _place(spark, f"{path}.new")
    out = fs.create(part, True)
    out.write(json.dumps(value).encode())
    out.close()
    fs.delete(where, False)
    fs.rename(part, where)


def drop(spark: SparkSession, path: str) -> None:
    where, fs = _place(spark, path)
    fs.delete(where, True)
