"""Relational queries over the tables: joins, aggregates, windows, sets, facts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import knowledge as K
from foliant.operators import relations as R
from foliant.operators import segment as S
from foliant.operators.repair import changed_terms
from foliant.operators.sequences import first_middle_last
from foliant.plans.base import derived, oracle, query, read

L = lambda c, a=None: (F.col(c) if isinstance(c, str) else c).cast("long").alias(a or c)


@query("SELECT c_custkey, 'cust_' || lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INTEGER, '0') AS id FROM customer")
def format_ids(spark, sf_dir):
    return read(spark, sf_dir, "customer", "c_custkey").select("c_custkey", T.padded_id("cust_", F.col("c_custkey")).alias("id"))


@query("SELECT c_custkey, 'nation' || c_nationkey || '::' || c_name AS id FROM customer")
def scope_ids(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    scope = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", T.scoped_id(scope, T.scoped_id(scope, F.col("c_name"))).alias("id"))


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def lookup_default_join(spark, sf_dir):
    n = read(spark, sf_dir, "nation").where("n_regionkey < 3")
    return read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("nation"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_known(spark, sf_dir):
    o = read(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer", "c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def anti_missing(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id").join(read(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti")


EDGES = "m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS v FROM lineitem), e AS (SELECT a.v AS source, b.v AS target, count(*)::BIGINT AS weight FROM m a JOIN m b ON a.g = b.g AND a.v < b.v GROUP BY 1, 2)"


def edges(spark, sf_dir):
    return R.cooccurrence(read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


@query(f"WITH {EDGES} SELECT source, target, weight, weight || ' 场同框' AS label FROM e")
def cooccurrence_edges(spark, sf_dir):
    return edges(spark, sf_dir).select("source", "target", "weight", F.concat(F.col("weight").cast("string"), F.lit(" 场同框")).alias("label"))


@query(f"WITH {EDGES}, b AS (SELECT source AS node, target AS o FROM e UNION ALL SELECT target, source FROM e) SELECT node, count(DISTINCT o)::BIGINT AS degree FROM b GROUP BY node")
def graph_degree(spark, sf_dir):
    return R.degrees(edges(spark, sf_dir), once=True)


@query(f"WITH {EDGES} SELECT CASE WHEN source = 7 THEN target ELSE source END AS neighbour, weight FROM e WHERE source = 7 OR target = 7")
def graph_neighbors(spark, sf_dir):
    return R.neighbours(edges(spark, sf_dir), F.lit(7))


@query("SELECT c.event_id, c.event_type AS now, coalesce(lead(event_type) OVER w, '') AS next, coalesce(lag(event_type) OVER w, '') AS before FROM events c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def adjacent_compare(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    return e.select("event_id", F.col("event_type").alias("now"), F.coalesce(F.lead("event_type").over(w), F.lit("")).alias("next"), F.coalesce(F.lag("event_type").over(w), F.lit("")).alias("before"))


@query("""SELECT k::BIGINT AS k, side FROM (
  SELECT k, 'shared' AS side FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
  UNION ALL SELECT k, 'left' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
  UNION ALL SELECT k, 'right' FROM (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer))""")
def shared_name_sets(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(L("c_nationkey", "k"))
    b = read(spark, sf_dir, "supplier").select(L("s_nationkey", "k"))
    tag = lambda d, s: d.select("k", F.lit(s).alias("side"))
    return tag(a.intersect(b), "shared").union(tag(a.subtract(b), "left")).union(tag(b.subtract(a), "right"))


@query("""SELECT k::BIGINT AS k, side FROM (
  SELECT k, 'shared' AS side FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey * 20 FROM supplier)
  UNION ALL SELECT k, 'left' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey * 20 FROM supplier)
  UNION ALL SELECT k, 'right' FROM (SELECT s_suppkey * 20 AS k FROM supplier EXCEPT SELECT c_custkey FROM customer))""")
def shared_key_sets(spark, sf_dir):
    """Sets over all customers; no side is empty."""
    a = read(spark, sf_dir, "customer").select(L("c_custkey", "k"))
    b = read(spark, sf_dir, "supplier").select(L(F.col("s_suppkey") * 20, "k"))
    tag = lambda d, s: d.select("k", F.lit(s).alias("side"))
    return tag(a.intersect(b), "shared").union(tag(a.subtract(b), "left")).union(tag(b.subtract(a), "right"))


@query("""WITH t AS (SELECT user_id, event_id, event_type || ':' || (floor(value / 10)::BIGINT)::VARCHAR AS term FROM events), s AS (SELECT user_id, list(DISTINCT term) FILTER (event_id % 2 = 0) AS a, list(DISTINCT term) FILTER (event_id % 2 = 1) AS b FROM t GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_concat(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)), list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x)))), ',') AS changed FROM s""")
def symmetric_difference(spark, sf_dir):
    """U-05: terms of a user's even events and not the odd ones, or the reverse."""
    term = F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 10).cast("string"))
    s = read(spark, sf_dir, "events").groupBy("user_id").agg(*(F.collect_set(F.when(F.col("event_id") % 2 == i, term)).alias(c) for i, c in ((0, "a"), (1, "b"))))
    return s.select("user_id", F.array_join(changed_terms(F.col("a"), F.col("b")), ",").alias("changed"))


@query("""SELECT o_custkey AS id, 'duplicate' AS rule FROM orders GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT o_custkey, 'unknown' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def partition_exactness(spark, sf_dir):
    expected = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return K.partition_errors(read(spark, sf_dir, "orders", F.col("o_custkey").alias("id")), expected, "id")


@query("""WITH a AS (SELECT c_nationkey AS k, max(c_custkey) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, max(s_suppkey) AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k""")
def priority_union_distinct(spark, sf_dir):
    a = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_custkey").alias("v"))
    b = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_suppkey").alias("v"))
    return K.priority_union(a, b, ["k"], "v")


@query("""WITH a AS (SELECT c_custkey AS k, max(c_nationkey) AS v FROM customer GROUP BY 1), b AS (SELECT s_suppkey * 20 AS k, max(s_nationkey) AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k""")
def priority_union_keys(spark, sf_dir):
    """The union over all customers."""
    a = read(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("k")).agg(F.max("c_nationkey").alias("v"))
    b = read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") * 20).alias("k")).agg(F.max("s_nationkey").alias("v"))
    return K.priority_union(a, b, ["k"], "v")


FACTS = """f AS (SELECT event_id AS id, user_id, event_type, ts, (floor(value)::BIGINT % 3) AS v, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events),
i AS (SELECT *, CASE WHEN row_number() OVER k = 1 OR lag(v) OVER k IS DISTINCT FROM v THEN 1 ELSE 0 END AS head FROM f WINDOW k AS (PARTITION BY user_id, event_type ORDER BY ts, id)),
n AS (SELECT *, sum(head) OVER (PARTITION BY user_id, event_type ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM i),
g AS (SELECT user_id, event_type, island, arg_min(id, (ts, id)) AS head_id, count(*) AS refs FROM n GROUP BY ALL),
r AS (SELECT *, min(CASE WHEN island = 1 OR head_id % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY island ROWS UNBOUNDED PRECEDING) AS ok FROM g)"""
FACT_KEY, FACT_ORDER = ["user_id", "event_type"], ["ts", "id"]


def facts(spark, sf_dir):
    e = read(spark, sf_dir, "events", F.col("event_id").alias("id"), "user_id", "event_type", "ts", "value")
    w = W.partitionBy(*FACT_KEY).orderBy(*FACT_ORDER)
    return e.withColumn("v", F.floor("value") % 3).withColumn("prev", F.when(F.col("id") % 4 != 0, F.lag("id").over(w)))


def reduced(spark, sf_dir):
    return K.reduce_facts(facts(spark, sf_dir), FACT_KEY, FACT_ORDER, F.col("v"), F.col("prev"))


@query(f"WITH {FACTS} SELECT id, island::BIGINT AS island FROM n")
def fact_islands(spark, sf_dir):
    return K.fact_islands(facts(spark, sf_dir), FACT_KEY, FACT_ORDER, F.col("v")).select("id", "island")


@query(f"WITH {FACTS} SELECT user_id, event_type, island::BIGINT AS island, head_id, refs::BIGINT AS refs, ok = 1 AS accepted FROM r")
def fact_reduce(spark, sf_dir):
    return reduced(spark, sf_dir)


@query(f"WITH {FACTS} SELECT user_id, event_type, head_id FROM r WHERE ok = 0")
def fact_conflicts(spark, sf_dir):
    return K.conflicts(reduced(spark, sf_dir)).select("user_id", "event_type", "head_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS ord FROM events")
def timeline_reduce(spark, sf_dir):
    return K.timeline(read(spark, sf_dir, "events", "event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).select("event_id", L("ord"))


@query("SELECT user_id, floor(value)::BIGINT AS pos, count(DISTINCT event_type)::BIGINT AS keys FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1")
def timeline_ambiguous(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", F.floor("value").alias("pos"), "event_type")
    return K.ambiguous_order(e, ["user_id", "pos"], F.col("event_type"))


THREADS = """a AS (SELECT user_id, (event_id // 500)::BIGINT AS seg, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'resolved' ELSE 'mentioned' END AS act FROM events),
t AS (SELECT user_id, seg, bool_or(act = 'open') AS opened, bool_or(act = 'resolved') AS resolved FROM a GROUP BY ALL HAVING bool_or(act IN ('open', 'resolved'))),
s AS (SELECT *, CASE WHEN opened THEN 'open' ELSE 'resolved' END AS state FROM t), z AS (SELECT *, coalesce(opened AND lag(state) OVER (PARTITION BY user_id ORDER BY seg) = 'resolved', false) AS reopened FROM s)"""


def threads(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", F.floor(F.col("event_id") / 500).alias("seg"), "event_type")
    act = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "resolved").otherwise("mentioned")
    return K.thread_states(e.withColumn("act", act), ["user_id"], "seg", "act")


@query(f"WITH {THREADS} SELECT user_id, seg, state, opened AND resolved AS same_segment FROM z")
def thread_lifecycle(spark, sf_dir):
    return threads(spark, sf_dir).select("user_id", "seg", "state", "same_segment")


@query(f"WITH {THREADS} SELECT user_id, seg FROM z WHERE reopened")
def thread_reopened(spark, sf_dir):
    return threads(spark, sf_dir).where("reopened").select("user_id", "seg")


@query("""WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, arg_min(event_type, (ts, event_id)) AS f, arg_max(event_type, (ts, event_id)) AS l FROM events GROUP BY ALL),
x AS (SELECT user_id, strftime(day, '%Y-%m-%d') AS day, l AS exit, lead(f) OVER (PARTITION BY user_id ORDER BY day) AS entry FROM d) SELECT * FROM x WHERE entry IS NOT NULL AND exit <> entry""")
def boundary_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    s = e.groupBy("user_id", "day").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("type_first"), F.max_by("event_type", F.struct("ts", "event_id")).alias("type_last"))
    return K.boundary_diff(s, ["user_id"], "day", "type")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, k::BIGINT AS k, event_id FROM r WHERE k IN (0, (n - 1) // 2, n - 1)""")
def evidence_sample3(spark, sf_dir):
    return first_middle_last(read(spark, sf_dir, "events", "user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], "event_id")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey)::BIGINT AS pos, coalesce(n || ' scenes', '未生成') AS state, round(o_totalprice / 1000, 1) || 'k' AS chars, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def project_list(spark, sf_dir):
    """O-01, I-01, X-21, K-10: the cards of all projects, newest first; only
    counts by day are summed in one task."""
    from foliant.operators.screenplay import renumber

    n = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice").join(n, "o_orderkey", "left")
    o = o.withColumn("age", F.coalesce(-F.unix_date(F.col("o_orderdate").cast("date")), F.lit(2**31 - 1)))
    state = F.coalesce(F.concat(F.col("n").cast("string"), F.lit(" scenes")), F.lit("未生成"))
    chars = F.concat(F.round(F.col("o_totalprice") / 1000, 1).cast("string"), F.lit("k"))
    return renumber(o, "age", [F.desc("o_orderdate"), "o_orderkey"]).select("o_orderkey", L("number", "pos"), state.alias("state"), chars.alias("chars"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey)::BIGINT AS pos, CASE WHEN o_orderstatus = 'F' THEN '12 scenes' ELSE '未生成' END AS state, round(o_totalprice / 1000, 1) AS k FROM orders")
def project_list_all(spark, sf_dir):
    """O-01, I-01 over all projects; only counts by day are summed in one task.
    Rows without a date come last."""
    from foliant.operators.screenplay import renumber

    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    o = o.withColumn("age", F.coalesce(-F.unix_date(F.col("o_orderdate").cast("date")), F.lit(2**31 - 1)))
    state = F.when(F.col("o_orderstatus") == "F", "12 scenes").otherwise("未生成")
    return renumber(o, "age", [F.desc("o_orderdate"), "o_orderkey"]).select("o_orderkey", L("number", "pos"), state.alias("state"), F.round(F.col("o_totalprice") / 1000, 1).alias("k"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, (o_orderdate, o_orderkey)) <> 'P'")
def project_latest_upsert(spark, sf_dir):
    """S-05, I-08: the latest version of a customer's orders; one of status P is a
    deletion, so a customer whose last version it is has none."""
    from foliant.sources.projects import latest

    return latest(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").where("o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderkey").alias("latest"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p.k IS NOT NULL THEN 'edited' ELSE l_linestatus END AS status, coalesce(p.q, l_quantity) AS quantity FROM lineitem
LEFT JOIN (SELECT DISTINCT o_orderkey AS k, 99.0::DOUBLE AS q FROM orders WHERE o_orderpriority = '1-URGENT') p ON p.k = l_orderkey AND l_linenumber = 1""")
def scene_edit_patch(spark, sf_dir):
    p = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).cast("long").alias("l_linenumber"), F.lit(99.0).alias("q"))
    x = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_quantity").join(p, ["l_orderkey", "l_linenumber"], "left")
    return x.select("l_orderkey", "l_linenumber", F.when(F.col("q").isNotNull(), "edited").otherwise(F.col("l_linestatus")).alias("status"), F.coalesce("q", "l_quantity").alias("quantity"))


@query("SELECT CASE WHEN c >= 0.7 THEN 'reliable' WHEN c >= 0.4 THEN 'review' ELSE 'doubtful' END AS tier, count(*)::BIGINT AS n FROM (SELECT coalesce(CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount * 10 END, 1.0) AS c FROM lineitem) GROUP BY 1")
def confidence_tier(spark, sf_dir):
    from foliant.operators.screenplay import confidence_tier as tier

    c = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount") * 10)
    return read(spark, sf_dir, "lineitem").groupBy(tier(c).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT role, min(conv_id * 1000 + turn)::BIGINT AS first_order, count(DISTINCT conv_id)::BIGINT AS scenes FROM conversations GROUP BY role")
def first_appearance(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("role").agg(L(F.min(F.col("conv_id") * 1000 + F.col("turn")), "first_order"), F.count_distinct("conv_id").alias("scenes"))


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers FROM conversations GROUP BY conv_id")
def speakers_per_scene(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("speakers"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn, role, text)::BIGINT AS number FROM conversations")
def renumber_scenes(spark, sf_dir):
    """G-03: numbering over all scenes without a global sort in one task."""
    from foliant.operators.screenplay import renumber

    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return renumber(c, "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", L("number"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, length(text) AS size FROM conversations),
f(conv_id, k, bin, used) AS (SELECT conv_id, k, 0, size FROM s WHERE k = 1 UNION ALL SELECT s.conv_id, s.k, CASE WHEN f.used + s.size > 600 THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.used + s.size > 600 THEN s.size ELSE f.used + s.size END FROM f JOIN s ON s.conv_id = f.conv_id AND s.k = f.k + 1)
SELECT conv_id, bin::BIGINT AS bin, count(*)::BIGINT AS scenes, max(used)::BIGINT AS used FROM f GROUP BY conv_id, bin""")
def scene_batching(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("s"))
    by = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: T.utf16_units(x["text"])).alias("sizes"))
    bins = by.select("conv_id", F.explode(F.arrays_zip(S.greedy_bins(F.col("sizes"), 600).alias("bin"), F.col("sizes"))).alias("x"))
    return bins.groupBy("conv_id", L("x.bin", "bin")).agg(F.count("*").alias("scenes"), L(F.sum("x.sizes"), "used"))


@query("SELECT conv_id, turn, (15 + floor(turn * 75.0 / max(turn) OVER (PARTITION BY conv_id) + 0.5))::BIGINT AS pct FROM conversations QUALIFY max(turn) OVER (PARTITION BY conv_id) > 0")
def progress_pct(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id", "turn").withColumn("m", F.max("turn").over(W.partitionBy("conv_id"))).where("m > 0")
    return c.select("conv_id", "turn", L(F.lit(15) + F.floor(F.col("turn") * 75.0 / F.col("m") + 0.5), "pct"))


@query("""SELECT 'duplicate' AS rule, l_orderkey || '/' || l_suppkey AS k FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    """A-12: every pair of keys in more than one row."""
    by = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")
    return by.select(F.lit("duplicate").alias("rule"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("k"))


@query("SELECT 'duplicate' AS rule, o_custkey::VARCHAR AS k FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """A-12: every key in more than one row."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("rule"), F.col("o_custkey").cast("string").alias("k"))


@query("SELECT o_orderpriority AS value, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def enum_violations(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def fk_violations(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").join(s, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT event_type AS route, count(*)::BIGINT AS calls, sum(floor(value))::BIGINT AS tokens, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000)::BIGINT AS wall_s, count_if(value > 50)::BIGINT AS errors, ((epoch_us(min(ts) FILTER (value <= 50)) - epoch_us(min(ts))) // 1000000)::BIGINT AS first_s FROM events GROUP BY 1")
def call_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route"))
    return e.agg(F.count("*").alias("calls"), L(F.sum(F.floor("value")), "tokens"), L(F.floor((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1000000), "wall_s"), F.count_if(F.col("value") > 50).alias("errors"), L(F.floor((F.unix_micros(F.min(F.when(F.col("value") <= 50, F.col("ts")).cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1000000), "first_s"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", L(F.get_json_object("props", "$.k"), "k"))


@query("SELECT 'orders' AS what, count(*)::BIGINT AS n, count_if(o_orderstatus = 'O')::BIGINT AS n_open, min(o_orderpriority) AS first_priority, bit_or((1 << (ascii(o_orderstatus) % 8)))::BIGINT AS mask FROM orders")
def summary_counts(spark, sf_dir):
    """A-10, A-11, A-16."""
    mask = F.expr("bit_or(shiftleft(1L, ascii(o_orderstatus) % 8))")
    return read(spark, sf_dir, "orders").agg(F.lit("orders").alias("what"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.min("o_orderpriority").alias("first_priority"), L(mask, "mask"))


STORED = "SELECT 'p' || o_custkey AS id, CAST(o_orderkey AS STRING) AS title, o_orderstatus AS novel, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at, o_orderkey % 10 AS part, o_custkey % 7 AS gone FROM orders"


@query(f"""WITH s AS ({STORED}), v AS (SELECT id, part, arg_max(title, (updated_at, title)) AS title FROM s GROUP BY id, part), d AS (SELECT DISTINCT id FROM s WHERE gone = 3),
k AS (SELECT id, arg_max(title, part) AS title FROM v WHERE part > 6 OR id NOT IN (SELECT id FROM d) GROUP BY id) SELECT id, title FROM k WHERE id LIKE 'p1%'""")
def project_store(spark, sf_dir):
    """S-05, I-08: orders put in ten parts, a seventh of the customers deleted in
    between, read by prefix: the last version of what is there."""
    from foliant.sources.projects import ProjectStore
    from foliant.sources.stage import shared_dir

    store = ProjectStore(spark, f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}")
    rows = derived(spark, sf_dir, STORED)
    for part in range(10):
        store.put(rows.where(F.col("part") == part))
        if part == 6:
            store.delete(rows.where("gone = 3").select("id").distinct())
    return store.scan("p1").select("id", "title")


@query(rf"""SELECT md5(coalesce(text, '')) AS digest, CASE WHEN doc_id % 3 = 0 AND source IS NOT NULL THEN source ELSE coalesce(substr(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^{T.WS}+|{T.WS}+$', '', 'g')), lambda x: length(x) > 0)[1], 1, 20), '未命名改编') END AS title, true AS stamped FROM documents""")
def new_project_rows(spark, sf_dir):
    """S-17: projects of all documents, a third of them under a title given."""
    from foliant.sources.projects import new_projects

    d = read(spark, sf_dir, "documents", "doc_id", "text", "source").select("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "source", F.lit(" "))).alias("given"))
    p = new_projects(d, "text", "given")
    stamped = (F.length("id") == 36) & (F.col("created_at") == F.col("updated_at"))
    return p.select(F.md5(F.coalesce("novel", F.lit("")).cast("binary")).alias("digest"), "title", stamped.alias("stamped"))


QUERIES, ORACLES = oracle(__name__)
