"""Projects, settings, event streams and the data sections of prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import headings as H
from foliant.operators import knowledge as K
from foliant.operators import screenplay as S
from foliant.plans.base import fixture, oracle, query, read, values
from foliant.plans.novels import NOVEL, novel
from foliant.sources import model as M
from foliant.sources import projects as P

L = lambda c, a=None: (F.col(c) if isinstance(c, str) else c).cast("long").alias(a or c)


@query("""WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '  ' || c_name || ' of a rather long and winding title' WHEN c_custkey % 3 = 1 THEN ' ' ELSE c_name END AS t FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey AS id, coalesce(CASE WHEN trim(t) = '' THEN '未命名改编' ELSE substr(trim(t), 1, 40) END, c_name) AS title, coalesce(CASE WHEN trim(t) = '' THEN '未命名改编' ELSE substr(trim(t), 1, 40) END <> c_name, false) AS changed FROM customer LEFT JOIN n ON n.id = c_custkey""")
def project_rename(spark, sf_dir):
    """P-16."""
    c = read(spark, sf_dir, "customer", F.col("c_custkey").alias("id"), F.col("c_name").alias("title")).withColumn("updated_at", F.lit(0))
    k = F.col("id") % 3
    t = F.when(k == 0, F.concat(F.lit("  "), "title", F.lit(" of a rather long and winding title"))).when(k == 1, " ").otherwise(F.col("title"))
    return P.renamed(c, c.where("id % 2 = 0").select("id", t.alias("title")), F.lit(1)).select("id", "title", (F.col("updated_at") == 1).alias("changed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'edited' ELSE l_linestatus END AS l_linestatus, CASE WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN 7.0 ELSE l_quantity END::DOUBLE AS l_quantity FROM lineitem""")
def scene_edit(spark, sf_dir):
    """P-15: a patch without a value marks the row only."""
    x = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_quantity").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    p = x.where("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, F.lit(7.0)).alias("l_quantity"))
    return P.edited(x, p, ["l_orderkey", "l_linenumber"], ["l_quantity"], "l_linestatus")


@query("SELECT c_custkey AS \"user\", CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'deepseek' END AS provider, 'm1' AS model FROM customer")
def settings_overlay(spark, sf_dir):
    """S-06: absent columns and null values come from the defaults."""
    u = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("provider"))
    return M.overlaid(u, {"provider": "deepseek", "model": "m1"})


READS = """('a', 1, 'data: {"progress":{"pct"'), ('a', 2, concat(':5}}', chr(10), chr(10), 'da')), ('a', 3, concat('ta: {"done":true,"scenes":3,"screenplay":{"characters":[1,2]},"validation":{"errors":[]}}', chr(10), 'data: {bad}', chr(10), 'data: {"late":1}')), ('b', 1, concat(': hello', chr(10)))"""


@fixture("SELECT * FROM (VALUES ('a', 0::BIGINT, '5'), ('a', 2, '')) t(stream, line_no, pct)")
def sse_reassembly(spark, sf_dir):
    """S-11: lines go on from read to read; the last one has no end yet."""
    e = M.reassembled(values(spark, READS, "stream, seq, piece"))
    return e.select("stream", L("line_no"), F.coalesce(F.get_json_object("event", "$.progress.pct"), F.lit("")).alias("pct"))


@fixture("SELECT 'a' AS stream, 3::BIGINT AS scenes, 2::BIGINT AS characters, false AS repaired, 0::BIGINT AS errors")
def done_stats(spark, sf_dir):
    """I-07."""
    return M.done_stats(M.reassembled(values(spark, READS, "stream, seq, piece")))


@fixture("SELECT * FROM (VALUES (1, 'ok', 5), (2, 'fallback', 0), (3, 'fallback', 0), (4, 'ok', 7)) t(id, status, n)")
def safe_parse(spark, sf_dir):
    """K-03: text without JSON gives the fallback."""
    r = values(spark, """(1, '{"status":"ok","n":5}'), (2, 'no'), (3, '{"status":'), (4, 'so {"status":"ok","n":7} it is')""", "id, raw")
    got = r.select("id", M.safe_parse(F.col("raw"), "struct<status:string,n:int>", F.struct(F.lit("fallback").alias("status"), F.lit(0).alias("n"))).alias("v"))
    return got.select("id", "v.status", "v.n")


@query("SELECT c_custkey, c_mktsegment || ':' || c_nationkey || ':' || c_custkey || '-' || (c_custkey + 1) AS ref, replace(lower(c_name), ' ', '') = replace(lower(upper(c_name)), ' ', '') AS same FROM customer")
def reference_keys(spark, sf_dir):
    """X-12, X-18."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    key = T.ref_key(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.col("c_custkey"), F.col("c_custkey") + 1)
    return c.select("c_custkey", key.alias("ref"), T.same_value(F.col("c_name"), F.upper("c_name")).alias("same"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber + 1 <= 3 THEN 'k1' WHEN l_linenumber >= 4 THEN 'k2' END AS chapter FROM lineitem")
def reference_chapters(spark, sf_dir):
    """K-06, J-05: a reference to two paragraphs has the chapter that holds both."""
    x = read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    o = read(spark, sf_dir, "orders", F.col("o_orderkey").alias("chunk_id"))
    r = o.select("chunk_id", F.explode(F.array(F.struct(F.lit("k1").alias("chapter_id"), F.lit(1).alias("start"), F.lit(3).alias("end")), F.struct(F.lit("k2").alias("chapter_id"), F.lit(4).alias("start"), F.lit(99).alias("end")))).alias("r")).select("chunk_id", "r.*")
    return K.chapter_of_refs(x, r).select(F.col("chunk_id").alias("l_orderkey"), F.col("start").alias("l_linenumber"), F.col("chapter_id").alias("chapter"))


@query(f"""WITH {NOVEL}, c AS (SELECT novel_id, n, length(text) + length('¶' || n || ' ') AS cost, max(n) OVER (PARTITION BY novel_id) AS last FROM novel), b AS (SELECT DISTINCT novel_id, ((n - 1) // 50) * 50 + 1 AS s, least(((n - 1) // 50) * 50 + 50, last) AS e FROM c)
SELECT b.novel_id, s::BIGINT AS first_n, e::BIGINT AS last_n, (sum(cost) + count(*) - 1)::BIGINT AS cost FROM b JOIN c ON c.novel_id = b.novel_id AND n BETWEEN s AND e GROUP BY ALL""")
def range_costs(spark, sf_dir):
    """J-05, P-04: the cost of ranges of 50 paragraphs by running totals."""
    rows = novel(spark, sf_dir)
    b = rows.groupBy("novel_id", F.floor((F.col("n") - 1) / 50).alias("b")).agg(F.min("n").alias("start"), F.max("n").alias("end")).drop("b")
    return H.cost_of_range(rows, b).select("novel_id", L("start", "first_n"), L("end", "last_n"), L("cost"))


@fixture("""SELECT 'p' AS project, '[{"id":"a","name":"苏禾","aliases":["小禾"],"description":"tall"},{"id":"b","name":"老贺"}]' AS "cast" """)
def prompt_cast(spark, sf_dir):
    """G-09, P-14."""
    return S.cast_section(values(spark, "('p', 2, 'b', '老贺', array(), ''), ('p', 1, 'a', '苏禾', array('小禾'), 'tall')", "project, ord, id, name, aliases, description"))


@query("SELECT conv_id AS project, role AS batch, string_agg('【' || turn || '】' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) AS section FROM conversations GROUP BY ALL")
def prompt_scenes(spark, sf_dir):
    """G-09."""
    c = read(spark, sf_dir, "conversations", F.col("conv_id").alias("project"), F.col("role").alias("batch"), F.col("turn").alias("number"), "text")
    return S.scene_section(c)


QUERIES, ORACLES = oracle(__name__)
