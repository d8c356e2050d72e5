"""Queries of chains and rolling state over ``events``: facts of a user (novel)
in order of time, one key an event type."""

from __future__ import annotations

import functools
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import chains, rolling_scan, trees
from foliant.operators.batches import pieces
from foliant.operators.paging import pages
from foliant.plans.base import oracle, query, read
from foliant.sources.events import EventSource
from foliant.sources.model import live
from foliant.sources.stage import shared_dir, staged
from foliant.streaming.facts import Run, RunFailed, merge_facts
from foliant.streaming.rolling import observed

#: What an event replaces: mostly the user's event before it, now and then a later one, which makes cycles of two and three.
LINKS = """l AS (SELECT event_id AS id, CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 211 = 6 THEN lead(event_id, 2) OVER w WHEN event_id % 173 = 5 THEN lead(event_id) OVER w ELSE lag(event_id) OVER w END AS nxt
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"""WITH RECURSIVE {LINKS},
walk(id, cur, path) AS (SELECT id, nxt, [id] FROM l WHERE nxt IS NOT NULL
  UNION ALL SELECT w.id, l.nxt, list_append(w.path, w.cur) FROM walk w JOIN l ON l.id = w.cur WHERE l.nxt IS NOT NULL AND NOT list_contains(w.path, w.cur)),
last AS (SELECT id, arg_max(cur, len(path)) AS head, arg_max(path, len(path)) AS path FROM walk GROUP BY id)
SELECT id, head, CASE WHEN list_contains(path, head) THEN list_position(path, head) - 1 ELSE len(path) END::BIGINT AS steps, list_contains(path, head) AS cyclic FROM last""")
def supersede_chase(spark, sf_dir):
    """J-14: where the chain of replaced events leads, cycles included."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = F.col("event_id")
    to = F.when(e % 53 == 0, None).when(e % 211 == 6, F.lead(e, 2).over(w)).when(e % 173 == 5, F.lead(e).over(w)).otherwise(F.lag(e).over(w))
    return chains.chase(read(spark, sf_dir, "events", "event_id", "user_id", "ts").select(e.alias("id"), to.alias("to")))


DELTAS = """e AS (SELECT user_id::VARCHAR AS novel_id, row_number() OVER u AS ord, event_type AS key,
  'e' || CASE WHEN event_id % 10 = 7 THEN coalesce(lag(event_id, 3) OVER u, event_id) ELSE event_id END AS id, (floor(value)::BIGINT % 3)::VARCHAR AS value,
  CASE WHEN event_id % 4 <> 0 THEN 'e' || lag(event_id) OVER t END AS sup
  FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id), t AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""
FOLD = f"""{DELTAS},
f(novel_id, ord, key, id, outcome, active, seen, now) AS (
  SELECT DISTINCT novel_id, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, MAP([]::VARCHAR[], []::VARCHAR[]), MAP([]::VARCHAR[], []::STRUCT(id VARCHAR, v VARCHAR)[]) FROM e
  UNION ALL
  SELECT novel_id, ord, key, id, outcome, CASE WHEN took THEN id ELSE now[key].id END,
    CASE WHEN took THEN map_concat(seen, MAP([id], [key || '/' || value])) ELSE seen END, CASE WHEN took THEN map_concat(now, MAP([key], [{{'id': id, 'v': value}}])) ELSE now END
  FROM (SELECT *, outcome IN ('new', 'replace') AS took FROM (SELECT e.novel_id, e.ord, e.key, e.id, e.value, f.seen, f.now,
    CASE WHEN f.seen[e.id] IS NOT NULL THEN CASE WHEN f.seen[e.id] = e.key || '/' || e.value THEN 'merge' ELSE 'conflict' END
      WHEN f.now[e.key] IS NULL THEN 'new' WHEN f.now[e.key].v = e.value THEN 'merge' WHEN e.sup = f.now[e.key].id THEN 'replace' ELSE 'conflict' END AS outcome
    FROM f JOIN e ON e.novel_id = f.novel_id AND e.ord = f.ord + 1)))"""
OUTCOMES = f"WITH RECURSIVE {FOLD} SELECT novel_id, ord, key, id, outcome, active FROM f WHERE ord > 0"


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (novel_id, ord, key, id, value, supersedes); a tenth has the id of an
    earlier event of the user, mostly under another key."""
    u = W.partitionBy("user_id").orderBy("ts", "event_id")
    t = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value")
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    return e.select(
        F.col("user_id").cast("string").alias("novel_id"),
        F.row_number().over(u).cast("long").alias("ord"),
        F.col("event_type").alias("key"),
        name(F.when(F.col("event_id") % 10 == 7, F.coalesce(F.lag("event_id", 3).over(u), "event_id")).otherwise(F.col("event_id"))).alias("id"),
        (F.floor("value") % 3).cast("string").alias("value"),
        F.when(F.col("event_id") % 4 != 0, name(F.lag("event_id").over(t))).alias("supersedes"),
    )


@query(OUTCOMES)
def rolling_scan_facts(spark, sf_dir):
    """F-06, E-05: the rolling merge as a composed scan."""
    return rolling_scan.roll_facts(deltas(spark, sf_dir))


CHUNK = 32


def arriving(spark: SparkSession, sf_dir: str):
    """(landing folder, chunks): each call of a chunk's function adds the facts of
    the next CHUNK ords of all novels to the landing folder."""
    rows = staged(deltas(spark, sf_dir).withColumn("chunk", F.floor((F.col("ord") - 1) / CHUNK)))
    landing = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    last = rows.agg(F.max("chunk")).first()[0]
    put = lambda k: rows.where(F.col("chunk") == k).drop("chunk").write.mode("append").parquet(landing)
    return landing, [functools.partial(put, k) for k in range(-1 if last is None else last + 1)], rows.drop("chunk").schema


def reach(batch: DataFrame) -> dict:
    """The ords that a trigger took the novels from and to."""
    got = batch.agg(F.min("ord"), F.max("ord")).first()
    return {"start": got[0], "end": got[1]}


@query(OUTCOMES)
def rolling_stream(spark, sf_dir):
    """M-01: the events streamed to their end in chunks, merged under state."""
    landing, chunks, schema = arriving(spark, sf_dir)
    run = Run(spark, f"{landing}-run", "events/rolling-2")
    for put in chunks:
        put()
        run.go(merge_facts(spark.readStream.schema(schema).parquet(landing)), reach)
    return run.results()


@query(OUTCOMES)
def rolling_resumed(spark, sf_dir):
    """M-02, M-08: the same stream, which fails once between its results and their
    commit and once between that and the engine's own, and goes on each time from
    the last durable chunk."""
    landing, chunks, schema = arriving(spark, sf_dir)
    faults = [("written", 1), ("committed", min(2, len(chunks) - 1))]

    def hook(what: str, number: int) -> None:
        if (what, number) in faults:
            faults.remove((what, number))
            raise OSError(f"lost after chunk {number} was {what}")

    for put in chunks:
        put()
        while True:
            run = Run(spark, f"{landing}-run", "events/rolling-2")
            try:
                run.go(merge_facts(spark.readStream.schema(schema).parquet(landing)), reach, hook)
                break
            except RunFailed as e:
                if "lost after" not in str(e.__cause__):
                    raise
    return run.results()


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def event_log(spark, sf_dir):
    """S-10, S-11: conversations written as server-sent events and read back in
    ranges of bytes that cut lines."""
    spark.dataSource.register(EventSource)
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("event")).write.format("sse").option("path", path).mode("append").save()
    return _turns(spark.read.format("sse").option("path", path).option("range", 10_000).load())


def _turns(events: DataFrame) -> DataFrame:
    row = F.from_json("event", "conv_id long, turn long, role string, text string")
    return events.select(row.alias("x")).select("x.conv_id", "x.turn", "x.role", F.md5(F.col("x.text").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def event_stream_log(spark, sf_dir):
    """S-10, M-03: the same as a stream into the source, each trigger listed once."""
    spark.dataSource.register(EventSource)
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    columns = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    s = spark.readStream.schema(columns).parquet(f"{sf_dir}/conversations.parquet*")
    events = s.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("event"))
    q = events.writeStream.format("sse").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return _turns(spark.read.format("sse").option("path", path).option("range", 10_000).load())


def answer(message: str | None) -> str:
    """A local stand-in for a model: the digest of what it is asked."""
    return hashlib.md5((message or "").encode()).hexdigest()


@query("SELECT doc_id, md5(coalesce(text, '')) AS raw, NULL::VARCHAR AS error FROM documents")
def call_pool(spark, sf_dir):
    """M-04, E-01: every document asked by a pool of four tasks with eight calls
    under way in each."""
    asked = read(spark, sf_dir, "documents", F.col("doc_id").alias("request_id"), F.col("text").alias("message"))
    return live(asked, answer, 4, 8).withColumnRenamed("request_id", "doc_id")


@query("SELECT count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest, count(DISTINCT lang)::BIGINT AS langs FROM documents")
def observed_counts(spark, sf_dir):
    """M-07, E-02: what was counted while the rows were made, beside a count of the
    rows themselves."""
    d = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    rows, seen = observed(d, "documents", n=F.count("*"), chars=F.sum(F.length("text")), longest=F.max(F.length("text")))
    made = staged(rows.select("doc_id", "lang"))
    counts = seen.get
    own = made.agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))
    return own.where(F.col("n") == counts["n"]).select("n", F.lit(counts["chars"]).cast("long").alias("chars"), F.lit(counts["longest"]).cast("long").alias("longest"), "langs")


@query("""WITH RECURSIVE s AS (SELECT source, doc_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f(source, doc_id, k, page, n, used) AS (SELECT source, doc_id, k, 0, 1, size FROM s WHERE k = 1
  UNION ALL SELECT s.source, s.doc_id, s.k, CASE WHEN f.n = 12 OR f.used + s.size > 20000 THEN f.page + 1 ELSE f.page END, CASE WHEN f.n = 12 OR f.used + s.size > 20000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n = 12 OR f.used + s.size > 20000 THEN s.size ELSE f.used + s.size END FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source AND s.k = f.k + 1)
SELECT source, doc_id, page::BIGINT AS page, n::BIGINT AS row, used::BIGINT AS used FROM f""")
def document_pages(spark, sf_dir):
    """E-04, O-09: the documents of a source dealt to pages by a table function."""
    d = read(spark, sf_dir, "documents", "source", "doc_id", "text").select("source", "doc_id", F.length("text").alias("size"))
    return pages(d, "source", "doc_id", F.col("size"), 12, 20_000)


ITEM = "'{' || CASE WHEN ch IS NOT NULL THEN '\"chapterId\":\"' || ch || '\",' ELSE '' END || '\"chunkId\":\"' || chunk || '\",\"paragraphRange\":{\"end\":' || e || ',\"start\":' || s || '}}'"


@query(f"""WITH i AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, CASE WHEN l_suppkey % 10 = 0 THEN 'other' ELSE 'c' || (l_orderkey % 5) END AS chunk, l_linenumber * 3 AS s, l_linenumber * 3 + l_partkey % 4 AS e FROM lineitem),
t AS (SELECT *, CASE WHEN chunk = 'other' THEN NULL WHEN e <= 10 THEN 'ch1' WHEN s >= 11 AND e <= 20 THEN 'ch2' END AS ch FROM i),
b AS (SELECT id, '[' || string_agg(repeat('{{"in":', n) || {ITEM} || repeat('}}', n), ',' ORDER BY n, p, s, e, chunk) || ']' AS items FROM t GROUP BY id)
SELECT o_orderkey AS id, '{{"items":' || coalesce(items, '[]') || ',"order":{{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}}}' AS json FROM orders LEFT JOIN b ON id = o_orderkey""")
def tree_rewrite(spark, sf_dir):
    """K-06: an answer an order, its lines nested as deep as their numbers; every
    reference in it gets its chapter."""
    line = read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), (F.col("l_suppkey") % 10 == 0).alias("other"))
    own = F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))
    # numbers move and texts are made where an order's lines are together; of equal lines the one of the order's own chunk is the first
    n = pieces(spark, line.count())
    by = line.repartition(n, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "p", "other"))).alias("lines"))

    def item(v):
        start = v["n"] * 3
        ref = F.to_json(F.struct(F.when(v["other"], "other").otherwise(own).alias("chunkId"), F.struct(start.alias("start"), (start + v["p"] % 4).alias("end")).alias("paragraphRange")))
        return F.concat(F.repeat(F.lit('{"in":'), v["n"]), ref, F.repeat(F.lit("}"), v["n"]))

    orders = read(spark, sf_dir, "orders", F.col("o_orderkey").alias("id"), "o_orderstatus").repartition(n, "id")
    o = orders.join(by, "id", "left")
    items = F.array_join(F.transform("lines", item), ",")
    whole = F.concat(F.lit('{"order":'), F.to_json(F.struct("id", F.col("o_orderstatus").alias("status"))), F.lit(',"items":['), F.coalesce(items, F.lit("")), F.lit("]}"))
    chapters = F.explode(F.array(F.struct(F.lit("ch1").alias("chapter_id"), F.lit(1).alias("start"), F.lit(10).alias("end")), F.struct(F.lit("ch2").alias("chapter_id"), F.lit(11).alias("start"), F.lit(20).alias("end"))))
    ranges = orders.select("id", own.alias("chunk_id"), chapters.alias("x")).select("id", "chunk_id", "x.*")
    return trees.with_chapters(o.select("id", whole.alias("json")), ranges)[0]


QUERIES, ORACLES = oracle(__name__)
