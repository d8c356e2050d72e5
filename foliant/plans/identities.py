"""Identity, merge and evidence-paging queries on inline fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import headings as H
from foliant.operators import identity as I
from foliant.plans.base import fixture, oracle, query, values


@fixture("SELECT * FROM (VALUES ('c1::a', 'c1::a,c1::b'), ('c1::b', '')) t(id, others)")
def scope_local_ids(spark, sf_dir):
    rows = values(spark, "('c1', 'a', array('a', 'c1::b')), ('c1', 'c1::b', cast(array() AS array<string>))", "chunk_id, id, others")
    return I.scope(rows, ["id", "others"]).select("id", F.array_join("others", ",").alias("others"))


STATES = "('n', 'object', 'key', 'holderCharacterId', 'lin', 4), ('n', 'object', 'key', 'location', 'yard', 4), ('n', 'object', 'key', 'state', '', 4), ('n', 'character', 'lin', 'location', 'x', 1)"
TOLD = "('n', 'object', 'key', 'Holder', 'wang', 9), ('n', 'object', 'key', 'unknown_mark', 'star', 9), ('n', 'object', 'key', 'holder_location', 'desk', 9), ('n', 'object', 'key', '位置', 'yard', 9), ('n', 'object', 'box', 'owner', 'zhao', 2), ('n', 'character', 'lin', 'location', 'v', 1)"


def objects(spark):
    b = values(spark, STATES, "novel_id, entity_type, entity_id, field, value, first")
    return I.object_candidates(b, values(spark, TOLD, "novel_id, kind, subject_id, predicate, value, first"))


@fixture(f"""WITH b AS (SELECT * FROM (VALUES {STATES}) t(novel_id, kind, id, field, value, first) WHERE kind = 'object' AND value <> ''), f AS (SELECT *, lower(predicate) AS p FROM (VALUES {TOLD}) t(novel_id, kind, id, predicate, value, first) WHERE kind = 'object'),
r AS (SELECT novel_id, id, first, CASE field WHEN 'holderCharacterId' THEN 'h' WHEN 'location' THEN 'l' ELSE 's' END AS what, value FROM b
UNION ALL SELECT novel_id, id, first, CASE WHEN contains(p, 'location') OR contains(p, '位置') THEN 'l' WHEN contains(p, 'holder') OR contains(p, '持有') THEN 'h' ELSE 's' END, CASE WHEN contains(p, 'location') OR contains(p, '位置') OR contains(p, 'holder') OR contains(p, '持有') THEN value ELSE predicate || ':' || value END FROM f)
SELECT id, coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (what = 'h'), '') AS holders, coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (what = 'l'), '') AS locations, coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (what = 's'), '') AS states, min(first) AS first FROM r GROUP BY id""")
def object_rollup(spark, sf_dir):
    """A-15."""
    return objects(spark).select("id", *(F.array_join(c, ",").alias(c) for c in ("holders", "locations", "states")), "first")


PEOPLE = "('n', 1, 'c1::a', '苏禾', 3), ('n', 2, 'c1::b', '老贺', 1), ('n', 3, 'c2::a', '苏 禾', 9), ('n', 4, 'c3::b', '贺伯', 12)"
LINES = "('n', 1, 'c2::t', '失踪的信', 5)"


def candidates(spark):
    c = values(spark, PEOPLE, "novel_id, ord, id, name, first")
    return I.identity_candidates(c, objects(spark), values(spark, LINES, "novel_id, ord, id, summary, first"))


@fixture(f"""WITH c AS (SELECT 'char' AS entity, 0 AS k, ord, id, name, first FROM (VALUES {PEOPLE}) t(novel_id, ord, id, name, first) UNION ALL SELECT 'object', 1, row_number() OVER (ORDER BY first, id), id, id, first FROM (VALUES ('key', 4), ('box', 2)) t(id, first)
UNION ALL SELECT 'thread', 2, ord, id, name, first FROM (VALUES {LINES}) t(novel_id, ord, id, name, first)) SELECT entity, row_number() OVER (ORDER BY k, ord, id)::BIGINT AS ord, id, name, first::BIGINT AS first FROM c""")
def identity_candidates(spark, sf_dir):
    """F-02."""
    return candidates(spark).select("entity", F.col("ord").cast("long").alias("ord"), "id", "name", "first")


@fixture("SELECT (i // 100)::BIGINT * 2 + CASE WHEN i < 100 AND i >= 50 OR i >= 150 AND i < 200 THEN 1 ELSE 0 END AS page, count(*)::BIGINT AS n FROM range(120) t(i) GROUP BY 1")
def candidate_paging(spark, sf_dir):
    """O-09: a block of 100 whose texts are too long is halved."""
    rows = spark.range(120).select(F.lit("n").alias("novel_id"), F.col("id").alias("ord"), F.lit(1500).alias("size"))
    return I.candidate_pages(rows).groupBy(F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n"))


PLANS = """('n', 0, '{"groups":[{"memberIds":["c1::a","c2::a"],"canonicalName":"苏禾","aliases":[],"decision":"same"},{"memberIds":["c1::b","c3::b"],"canonicalName":"王","aliases":[],"decision":"uncertain"}],"objectGroups":[{"memberIds":["key"],"canonicalName":"钥匙","decision":"same"}],"threadGroups":[]}'),
('n', 1, '{"groups":[],"objectGroups":[{"memberIds":["box"],"canonicalName":"盒","decision":"same"}],"threadGroups":[{"memberIds":["c2::t"],"canonicalSummary":"那封信","decision":"same"}]}')"""
PAGED = "('c1::a', 0), ('c1::b', 0), ('c2::a', 0), ('c3::b', 0), ('key', 0), ('box', 1), ('c2::t', 1)"


def planned(spark, pages: str = PAGED, plans: str = PLANS):
    c = candidates(spark).join(values(spark, pages, "id, page"), "id")
    return c, *I.parse_plan(values(spark, plans, "novel_id, page, raw"), c)


@fixture("""SELECT * FROM (VALUES ('char', 'char_0001', '老贺', 'uncertain', 'c1::b'), ('char', 'char_0002', '苏禾', 'uncertain', 'c1::a,c2::a'), ('char', 'char_0003', '贺伯', 'uncertain', 'c3::b'), ('object', 'object_0001', '盒', 'uncertain', 'box'), ('object', 'object_0002', '钥匙', 'uncertain', 'key'), ('thread', 'thread_0001', '那封信', 'uncertain', 'c2::t')) t(entity, canonical_id, name, decision, members)""")
def page_merge(spark, sf_dir):
    """F-03, F-04, T11, T12: plans of two pages, numbered over both; no decision
    of a paged novel is certain."""
    c, plan, _ = planned(spark)
    return I.assign(plan, c).select("entity", "canonical_id", "name", "decision", F.array_join("member_ids", ",").alias("members"))


@fixture("SELECT * FROM (VALUES ('conflict_identity_001', 'c1::b,c3::b'), ('conflict_identity_pagination_001', '')) t(id, members)")
def identity_uncertain(spark, sf_dir):
    """T11, T12."""
    return I.identity_conflicts(planned(spark)[1]).select("id", F.array_join("members", ",").alias("members"))


ONE_PAGE = "('c1::a', 0), ('c1::b', 0), ('c2::a', 0), ('c3::b', 0), ('key', 0), ('box', 0), ('c2::t', 0)"
BAD_PLAN = """('n', 0, '{"groups":[{"memberIds":["c1::a","c1::a"],"canonicalName":" ","aliases":[],"decision":"same"},{"memberIds":[],"canonicalName":"x","decision":"maybe"},{"memberIds":["zz","c2::a"],"canonicalName":"y","aliases":["y"],"decision":"same"}],"objectGroups":[{"memberIds":["key","box"],"canonicalName":"k","decision":"same"}]}')"""


@fixture("""SELECT * FROM (VALUES ('char', 'name_empty', '0'), ('char', 'members_empty', '1'), ('char', 'aliases', '1'), ('char', 'decision', '1'), ('char', 'duplicate_member', 'c1::a'), ('char', 'unknown_member', 'zz'), ('char', 'missing_member', 'c1::b'), ('char', 'missing_member', 'c3::b'), ('thread', 'missing_list', 'threadGroups')) t(entity, rule, "at")""")
def plan_errors(spark, sf_dir):
    """F-03, U-06."""
    return planned(spark, ONE_PAGE, BAD_PLAN)[2].select("entity", "rule", "at")


REFS = "('n', 'a', 1, 1, 1), ('n', 'a', 2, 2, 3), ('n', 'a', 3, 3, 3), ('n', 'a', 4, 4, 9), ('n', 'b', 1, 7, 8)"


@fixture("SELECT * FROM (VALUES ('a', 1, '¶1 ' || repeat('x', 10)), ('a', 2, '¶2 ' || repeat('x', 20) || chr(10) || '¶3 xxx'), ('a', 4, ''), ('b', 1, '')) t(id, pos, snippet)")
def evidence_snippets(spark, sf_dir):
    """O-06, O-08: first, middle and last of four references in 43 characters."""
    p = values(spark, "('n', 1, repeat('x', 10)), ('n', 2, repeat('x', 20)), ('n', 3, repeat('x', 30)), ('n', 4, 'y')", "novel_id, n, text")
    return I.evidence_snippets(values(spark, REFS, "novel_id, id, pos, start, end"), p, 43).select("id", "pos", "snippet")


@fixture("SELECT * FROM (VALUES ('char_0001', '苏禾', '小禾,阿禾', 'tall', 'confirmed'), ('char_0002', '老贺', '', '', 'provisional')) t(canonical_id, name, aliases, description, status)")
def character_build(spark, sf_dir):
    m = values(spark, "('char_0001', '苏禾', array('小禾'), '', 'same', 1), ('char_0001', '阿禾', array('苏禾'), 'tall', 'same', 4), ('char_0002', '老贺', NULL, '', 'uncertain', 2)", "canonical_id, name, aliases, description, decision, first")
    c = I.build_characters(m)
    return c.select("canonical_id", "name", F.array_join("aliases", ",").alias("aliases"), F.coalesce("description", F.lit("")).alias("description"), "status")


@fixture("SELECT * FROM (VALUES ('char_0001', 'loc', 'Yard', false), ('x', 'loc', 'a', true)) t(id, field, value, ambiguous)")
def canonical_rewrite(spark, sf_dir):
    rows = values(spark, "('c1::a', 'loc', 'yard'), ('c2::a', 'loc', 'Yard'), ('c2::a', 'loc', ''), ('x', 'loc', 'a'), ('x', 'loc', 'b')", "id, field, value")
    return I.merge_scalars(I.rewrite(rows, values(spark, "('c1::a', 'char_0001'), ('c2::a', 'char_0001')", "member_id, canonical_id"), ["id"]), ["id", "field"], "value")


@fixture("SELECT * FROM (VALUES (1, 'a', 'same'), (2, 'b', 'conflict'), (3, 'c', 'provisional'), (4, 'd', 'new'), (5, 'a', 'conflict'), (6, 'a', 'conflict'), (7, 'e', 'provisional')) t(ord, id, outcome)")
def character_match(spark, sf_dir):
    """F-07: a known name again; another name under a known id; somebody's name
    under a new id; a name of nobody's; another primary name with a shared alias;
    an alias that is somebody else's; a name that came in this delta."""
    known = values(spark, "('n', 1, 'a', '苏禾', array('小禾')), ('n', 2, 'b', '老贺', array())", "novel_id, ord, id, name, aliases")
    rows = "('n', 1, 'a', '苏 禾', array('禾禾')), ('n', 2, 'b', '赵', array()), ('n', 3, 'c', '老贺', array()), ('n', 4, 'd', '新人', array('他')), ('n', 5, 'a', '阿禾', array('小禾')), ('n', 6, 'a', '苏禾', array('新人')), ('n', 7, 'e', '某人', array('他', '新人'))"
    return I.match_characters(values(spark, rows, "novel_id, ord, id, name, aliases"), known).select(F.col("ord").cast("int").alias("ord"), "id", "outcome")


STATE, OPENED, CLOSED = "('t1', 'x', 'open'), ('t2', 'y', 'resolved')", "(1, 't2', 'y again'), (2, 't3', 'z'), (3, 't3', 'Z '), (4, 't1', 'X')", "('t1'), ('t9')"


def thread_delta(spark):
    tag = lambda d: d.withColumn("novel_id", F.lit("n"))
    return I.merge_threads(tag(values(spark, STATE, "id, summary, status")), tag(values(spark, OPENED, "ord, id, summary")), tag(values(spark, CLOSED, "id")))


@fixture(f"""WITH s AS (SELECT id, summary, status, 0 AS ord FROM (VALUES {STATE}) t(id, summary, status) UNION ALL SELECT id, summary, 'open', ord FROM (VALUES {OPENED}) t(ord, id, summary)), k AS (SELECT id, arg_min(summary, ord) AS summary, arg_min(status, ord) AS status FROM s GROUP BY id)
SELECT id, summary, CASE WHEN id IN (SELECT * FROM (VALUES {CLOSED})) THEN 'resolved' ELSE status END AS status FROM k""")
def thread_merge(spark, sf_dir):
    """F-09: a thread opened again keeps its summary and its status."""
    return thread_delta(spark)[0].select("id", "summary", "status")


@fixture(f"""WITH s AS (SELECT id, summary, 0 AS ord FROM (VALUES {STATE}) t(id, summary, status) UNION ALL SELECT id, summary, ord FROM (VALUES {OPENED}) t(ord, id, summary)), k AS (SELECT *, first_value(summary) OVER (PARTITION BY id ORDER BY ord) AS f FROM s)
SELECT id, 'thread_differs' AS rule FROM k WHERE replace(lower(summary), ' ', '') <> replace(lower(f), ' ', '') UNION ALL SELECT col0, 'thread_missing' FROM (VALUES {CLOSED}) WHERE col0 NOT IN (SELECT id FROM s)""")
def thread_merge_conflicts(spark, sf_dir):
    """F-09, T15."""
    return thread_delta(spark)[1].select("id", "rule")


RAISED = "(5, 'timeline', 'b'), (2, 'fact_value', 'a')"


@fixture(f"SELECT 'conflict_v1_001' AS id, 'resolved' AS status UNION ALL SELECT 'conflict_v2_' || lpad((row_number() OVER (ORDER BY ord))::VARCHAR, 3, '0'), 'open' FROM (VALUES {RAISED}) t(ord, type, description)")
def conflict_merge(spark, sf_dir):
    """F-10."""
    tag = lambda d: d.withColumn("novel_id", F.lit("n"))
    state = tag(values(spark, "('conflict_v1_001', 'identity', 'd', 'open')", "id, type, description, status"))
    return I.merge_conflicts(state, tag(values(spark, RAISED, "ord, type, description")), tag(values(spark, "('conflict_v1_001')", "id")), F.lit(2)).select("id", "status")


@fixture("SELECT novel_id, count(*)::BIGINT AS n, (max(page) + 1)::BIGINT AS pages FROM (VALUES ('a', 0), ('a', 0), ('a', 1)) t(novel_id, page) GROUP BY novel_id")
def evidence_paging(spark, sf_dir):
    rows = values(spark, "('a', 1, 10), ('a', 2, 10), ('a', 3, 10)", "novel_id, n, size")
    return H.evidence_pages(rows, 21).groupBy("novel_id").agg(F.count("*").alias("n"), (F.max("page") + 1).cast("long").alias("pages"))


QUERIES, ORACLES = oracle(__name__)
