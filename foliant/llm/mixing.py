"""Operator 10: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w, with u a uniform number
derived from its id and w its quality weight; taking the smallest keys first is
weighted sampling without replacement.  A source's token budget is met with
complete epochs, then with the documents of smallest key whose sizes fill the
rest.  Everything is JVM-side: the keys are written once, cut into buckets at
their own quantiles, bucket totals give the prefix sum up to a bucket, and rows
are only ordered inside a bucket, so a source that holds a third of all rows
never meets in one task.  Rows that are equal in all that orders them are counted
before they are ordered, so repeated rows don't meet either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import durable, release, table, word_count

BUCKETS = 1024
CAP = 3
SEED = "mix"
MAX_SOURCES = 100_000


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1] from the id's md5: the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))


def default_quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: largest for texts whose words average 5.5 characters
    plus one of white space, falling with the distance from that."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.5)) / F.lit(6.5))


def targets(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3 repeating over the sources
    by code point, null last, share all sizes; a target stops at ``cap`` times
    its source's size and the excess goes to the others by weight.

    In order of cap / weight, the first k sources are full and the rest share
    what remains at one level; k is where that level no longer exceeds the next
    source's own ratio.  One row a source goes through the ordering.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("w", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    order = W.orderBy(F.col("source_size") * cap / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    by = by.select(
        "*",
        ((F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum("w").over(rest)).alias("level"),
        (F.col("source_size") * cap / F.col("w")).alias("ratio"),
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(W.partitionBy())["level"]
    by = by.withColumn("at", level)
    return by.select("source", "source_size", F.least(F.col("w") * F.col("at"), (F.col("source_size") * cap).cast("double")).alias("target"))


def sort_key(quality: Column | None, seed: str = SEED, size: Column | None = None) -> Column:
    """The exponential key of a row with doc_id and text."""
    q = quality if quality is not None else default_quality(F.coalesce(F.col("text"), F.lit("")), word_count(F.col("text")) if size is None else size)
    return -F.log(uniform(F.col("doc_id"), seed)) / F.greatest(q, F.lit(1e-6))


def planned(keyed: DataFrame, cap: int = CAP, buckets: int = BUCKETS) -> DataFrame:
    """The plan of ``keyed`` rows (doc_id, source, size, key): each distinct row
    once, with ``n``, how often it stands there, source_size, target, ``epochs``,
    whole passes over its source, and ``more``, how many of the n are taken once
    more.  The order within a source is that of key, doc_id and size.
    """
    goal = targets(keyed.select("source", "size"), cap)
    edges = keyed.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    alike = keyed.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("bucket", below(F.col("key"), edges))
    ahead = alike.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("here"))
    ahead = ahead.select("source", "bucket", (F.sum("here").over(W.partitionBy("source").orderBy("bucket")) - F.col("here")).alias("ahead"))
    plan = ahead.alias("a").join(goal.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source"))).select("a.source", "bucket", "ahead", "source_size", "target")
    order = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = alike.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(order))
    rows = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    rows = rows.select("r.doc_id", "r.source", "r.key", "r.size", "r.n", "p.source_size", "p.target", (F.col("upto") + F.col("ahead") - F.col("size") * F.col("n")).alias("before"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    # copy i of n ends at before + i * size: taken if that is within what is left, or overshoots by less than it is short without
    left = F.col("target") - epochs * F.col("source_size") - F.col("before")
    whole = F.floor(left / F.greatest(F.col("size"), F.lit(1)))
    rest = left - whole * F.col("size")
    more = F.least(F.greatest(whole + F.when((left > 0) & (rest > 0) & (F.col("size") - rest < rest), 1).otherwise(0), F.lit(0)), F.col("n"))
    return rows.select("doc_id", "source", "key", "size", "n", "source_size", "target", epochs.alias("epochs"), F.when(F.col("size") > 0, more).otherwise(0).cast("long").alias("more"))


def below(key: Column, edges: list[float]) -> Column:
    """How many of the sorted ``edges`` are smaller than ``key``, by bisection."""
    if not edges:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(repr, edges))), ",").cast("array<double>")
    zero = F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi"))

    def halve(x: Column, _: Column) -> Column:
        mid = F.shiftright(x["lo"] + x["hi"], 1)
        right = (x["lo"] < x["hi"]) & (F.get(held, mid) < key)
        return F.struct(F.when(right, mid + 1).otherwise(x["lo"]).alias("lo"), F.when(right, x["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(edges).bit_length())), zero, halve, lambda x: x["lo"])


def keyed(docs: DataFrame, quality: Column | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, key) of every row, written once."""
    return durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), sort_key(quality, seed).alias("key")))


def mix(docs: DataFrame, quality: Column | None = None, cap: int = CAP, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Mixes ``docs`` (doc_id, text, source) to the target weights.

    Returns doc_id, size, source_size, target and taken.  A document whose size
    crosses what is left of the target is taken when that leaves the source
    nearer its target.  Null text has size 0 and takes 0; null is a source of
    its own; repeated rows are mixed one by one; an empty table gives no rows;
    columns beyond those named are ignored.
    """
    rows = keyed(docs, quality, seed)
    plan = planned(rows, cap, buckets).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    times = F.col("epochs") + (F.col("i") <= F.col("more")).cast("long")
    out = durable(plan.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken")))
    release(rows)
    return out


def take(docs: DataFrame, quality: Column | None = None, cap: int = CAP, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """The mixed rows of ``docs`` themselves, each as often as ``mix`` takes it;
    documents without words are in no mix.

    Only ids and numbers are shuffled: a source's fractional selection ends at
    one row of the order, so the texts are filtered where they are read.  Of
    rows that are equal in that order where the selection ends, those of smallest
    hash go first; equal ones among them are counted, not ordered.
    """
    columns = docs.columns
    rows = keyed(docs, quality, seed)
    last = F.struct("key", "doc_id", "size")
    taken = F.when(F.col("more") > 0, F.struct(last.alias("at"), "n", "more"))
    cuts = durable(planned(rows, cap, buckets).groupBy(F.col("source").alias("_source")).agg(F.max("epochs").alias("_epochs"), F.max(taken).alias("_cut")))
    release(rows)
    partial = not cuts.where("_cut.n > _cut.more").isEmpty()
    if cuts.count() <= MAX_SOURCES:
        cuts = F.broadcast(cuts)
    # a generator's output is computed once, however often it is used below
    sized = docs.select("*", F.explode(F.array(word_count(F.col("text")))).alias("_size")).where("_size > 0")
    key = F.struct(sort_key(quality, seed, F.col("_size")).alias("key"), F.col("doc_id"), F.col("_size").alias("size"))
    rows = sized.select("*", F.explode(F.array(key)).alias("_key")).join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    tied = F.coalesce((F.col("_key") == F.col("_cut.at")) & (F.col("_cut.n") > F.col("_cut.more")), F.lit(False))
    times = F.col("_epochs") + F.coalesce((F.col("_key") <= F.col("_cut.at")).cast("long"), F.lit(0))
    whole = (rows.where(~tied) if partial else rows).select(*columns, times.alias("_times"))
    if partial:
        counted = rows.where(tied).groupBy(*columns, "_epochs", F.col("_cut.more").alias("_more")).agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(W.partitionBy("source").orderBy(F.xxhash64(*columns)).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
        once = F.least(F.greatest(F.col("_more") - before, F.lit(0)), F.col("_n"))
        whole = whole.unionByName(counted.select(*columns, (F.col("_epochs") * F.col("_n") + once).alias("_times")))
    whole = whole.where("_times > 0")
    return whole.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_i")).select(*columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0)
           / greatest(1.0 / (1.0 + abs(length(text)::DOUBLE / greatest(size, 1) - 6.5) / 6.5), 1e-6) AS k FROM words),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM keyed GROUP BY source),
levels AS (
  SELECT *, source_size * 3 / w AS ratio,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM by_source),
goal AS (
  SELECT source, source_size, least(w * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1), (source_size * 3)::DOUBLE) AS target FROM levels),
run AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9)::BIGINT ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY keyed.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM keyed JOIN goal ON keyed.source IS NOT DISTINCT FROM goal.source),
cut AS (SELECT *, target - epochs * source_size AS rest FROM run)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size)) THEN size ELSE 0 END)::BIGINT AS taken
FROM cut
"""
