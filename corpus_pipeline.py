"""A corpus pipeline of five stages, each written as Parquet and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and works
on all rows the stage before it kept.  All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import jaccard_join, mixing, quality_cnn, secrets, sentencepieces
from foliant.llm.common import durable, release, table


#: Ids and text keys of removed rows are broadcast up to this number (about 100
#: bytes each); beyond it the documents are shuffled by them.
MAX_BROADCAST = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  It is fitted on the
    labelled documents among ``docs``; without labels none is rejected."""
    network = quality_cnn.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), F.lit(True))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return quality_cnn.classify(whole, network, ("doc",)).where("predicted = 1").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by the n-gram Jaccard join one row stays:
    that of the smallest doc_id, rows without an id coming last, and of several
    rows with that id that of the smallest hash of the text; of repeated rows one.
    Rows are told apart by id and text.  Documents without words link with
    nothing and stay."""
    classes = jaccard_join.join(docs).where("class_id is not null").withColumn("row", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key"))
    stays = classes.groupBy("class_id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    others = durable(classes.join(stays, "class_id").select("doc_id", "text_key", (F.col("row") == F.col("first")).alias("first")))
    gone = others.where("not first").distinct()
    twice = others.where("first").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if others.count() <= MAX_BROADCAST:
        gone, twice = F.broadcast(gone), F.broadcast(twice)

    def same(r: DataFrame) -> Column:
        return F.col("d.doc_id").eqNullSafe(r["doc_id"]) & (F.col("d._text_key") == r["text_key"])

    kept = docs.withColumn("_text_key", jaccard_join.text_key()).alias("d").join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    again = kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return kept.join(twice, same(twice), "left_anti").unionByName(again).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found in a text is replaced by a mask; n_chars follows."""
    ratios = secrets.train(secrets.labelled(docs))
    done = secrets.redact(docs, ratios)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else done


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: each document as many times as
    the mix takes it."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the SentencePiece ids of every text, in column pieces."""
    return sentencepieces.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("secret scans", mask_secrets),
    ("source mixing", mix),
    ("sentencepiece encoding", encode),
]

#: The classifier and the join have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, sf_dir))
        release(before)
    return durable(STAGES[-1][1](spark, docs, sf_dir))
