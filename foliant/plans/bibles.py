"""Knowledge-base, model-boundary and screenplay operators over the given tables:
users are novels and their events facts, threads and characters; orders are
chunks; conversations are screenplays.  The derivations are SQL that Spark and the
oracle both read."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import headings as H
from foliant.operators import identity as I
from foliant.operators import knowledge as K
from foliant.operators import repair as P
from foliant.operators import rules as R
from foliant.operators import screenplay as S
from foliant.plans.base import derived, oracle, query, read
from foliant.sources import model as M

L = lambda c, a=None: (F.col(c) if isinstance(c, str) else c).cast("long").alias(a or c)
PAD = "lpad(CAST({} AS STRING), 3, '0')"

EVENTS = "SELECT CAST(user_id AS STRING) AS novel_id, event_id AS e, event_type AS kind, CAST(floor(value) AS BIGINT) AS v FROM events"


# F-08: a timeline of every other event, and a delta of all; fifty ids a novel come again and again.
TOLD = f"SELECT novel_id, 'e' || (e % 50) AS id, CASE WHEN e % 3 = 0 THEN kind WHEN e % 3 = 1 THEN upper(kind) || ' ' ELSE 'other' END AS summary, v AS first, e AS ord, e % 2 AS p FROM ({EVENTS}) x"


@query(f"""WITH r AS ({TOLD}), k AS (SELECT *, row_number() OVER (PARTITION BY novel_id, id ORDER BY p, ord) AS k FROM r)
SELECT novel_id, id, summary, row_number() OVER (PARTITION BY novel_id ORDER BY first, p, ord)::BIGINT AS ord FROM k WHERE k = 1""")
def timeline_of_events(spark, sf_dir):
    """F-08."""
    r = derived(spark, sf_dir, TOLD)
    return K.merge_timeline(r.where("p = 0").drop("p"), r.where("p = 1").drop("p"))[0].select("novel_id", "id", "summary", L("ord"))


@query(f"""WITH r AS ({TOLD}), k AS (SELECT *, row_number() OVER w AS k, first_value(summary) OVER w AS f FROM r WINDOW w AS (PARTITION BY novel_id, id ORDER BY p, ord))
SELECT novel_id, id, 'timeline_differs' AS rule FROM k WHERE k > 1 AND lower(trim(summary)) <> lower(trim(f))""")
def timeline_conflicts(spark, sf_dir):
    """F-08."""
    r = derived(spark, sf_dir, TOLD)
    return K.merge_timeline(r.where("p = 0").drop("p"), r.where("p = 1").drop("p"))[1]


# F-09: threads of the early events, opened again and closed by later ones.
THREADS = f"SELECT novel_id, 't' || (e % 40) AS id, CASE WHEN e % 5 = 0 THEN kind || ' ' ELSE kind END AS summary, CASE WHEN v % 2 = 0 THEN 'open' ELSE 'resolved' END AS status, e AS ord, e % 3 AS part FROM ({EVENTS}) x"
OLD = f"SELECT novel_id, id, min(summary) AS summary, min(status) AS status FROM ({THREADS}) y WHERE part = 0 GROUP BY novel_id, id"
REOPENED = f"SELECT novel_id, id, summary, ord FROM ({THREADS}) y WHERE part = 1"
SHUT = f"SELECT DISTINCT novel_id, id FROM ({THREADS}) y WHERE part = 2"


def threads(spark, sf_dir):
    return I.merge_threads(*(derived(spark, sf_dir, x) for x in (OLD, REOPENED, SHUT)))


THREAD_ROWS = f"s AS (SELECT novel_id, id, summary, status, 0 AS p, 0 AS ord FROM ({OLD}) o UNION ALL SELECT novel_id, id, summary, 'open', 1, ord FROM ({REOPENED}) n), k AS (SELECT *, row_number() OVER w AS k, first_value(summary) OVER w AS f FROM s WINDOW w AS (PARTITION BY novel_id, id ORDER BY p, ord)), d AS ({SHUT})"


@query(f"WITH {THREAD_ROWS} SELECT k.novel_id, k.id, summary, CASE WHEN d.id IS NOT NULL THEN 'resolved' ELSE status END AS status FROM k LEFT JOIN d ON d.novel_id = k.novel_id AND d.id = k.id WHERE k = 1")
def threads_of_events(spark, sf_dir):
    """F-09."""
    return threads(spark, sf_dir)[0]


@query(f"""WITH {THREAD_ROWS} SELECT novel_id, id, 'thread_differs' AS rule FROM k WHERE k > 1 AND trim(summary) <> trim(f)
UNION ALL SELECT novel_id, id, 'thread_missing' FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.novel_id = d.novel_id AND s.id = d.id)""")
def thread_conflicts(spark, sf_dir):
    """F-09, T15."""
    return threads(spark, sf_dir)[1]


RAISED = f"SELECT novel_id, e AS ord, kind AS type, 'at ' || v AS description, v % 4 = 0 AS closes FROM ({EVENTS}) x WHERE e % 7 = 3"
HELD = "SELECT DISTINCT CAST(user_id AS STRING) AS novel_id, 'conflict_v1_' || CAST(100 + event_id % 5 AS STRING) AS id, 'identity' AS type, 'd' AS description, 'open' AS status FROM events WHERE event_id % 3 = 0"


@query(f"""WITH r AS (SELECT *, 'conflict_v2_' || {PAD.format('row_number() OVER (PARTITION BY novel_id ORDER BY ord)')} AS id FROM ({RAISED}) x), s AS ({HELD})
SELECT novel_id, id, type, description, 'open' AS status FROM r UNION ALL SELECT s.novel_id, s.id, type, description, CASE WHEN id IN ('conflict_v1_100', 'conflict_v1_103') THEN 'resolved' ELSE status END FROM s""")
def conflicts_of_events(spark, sf_dir):
    """F-10."""
    held = derived(spark, sf_dir, HELD)
    return I.merge_conflicts(held, derived(spark, sf_dir, RAISED).drop("closes"), held.where("id in ('conflict_v1_100', 'conflict_v1_103')").select("novel_id", "id"), F.lit(2))


# F-15: what holds at the start and the end of each line number of an order.
STATES = """SELECT l_orderkey AS k, l_linenumber AS idx, min(l_partkey) % 4 AS a, min(l_suppkey) % 3 AS b, min(l_partkey) % 5 AS c FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@query(f"""WITH s AS ({STATES}), z AS (SELECT k, idx, side, entity, id, field, v FROM (SELECT *, unnest([
  {{'side': 'entry', 'entity': 'scene', 'id': 'scene', 'field': 'location', 'v': CASE a WHEN 0 THEN NULL WHEN 1 THEN 'The Yard' WHEN 2 THEN 'the yard' ELSE 'street' END}}, {{'side': 'exit', 'entity': 'scene', 'id': 'scene', 'field': 'location', 'v': CASE b WHEN 0 THEN 'theyard' WHEN 1 THEN 'house' END}},
  {{'side': 'entry', 'entity': 'character', 'id': 'p' || b, 'field': 'knowledge', 'v': CASE c WHEN 0 THEN '[]' ELSE '["x","y' || c || '"]' END}}, {{'side': 'exit', 'entity': 'character', 'id': 'p' || b, 'field': 'knowledge', 'v': CASE c WHEN 0 THEN '[]' ELSE '["x"]' END}}], recursive := true) FROM s) WHERE v IS NOT NULL),
j AS (SELECT a.k, a.idx AS li, b.idx AS ri, a.entity, a.id, a.field, a.v AS lv, b.v AS rv FROM z a JOIN z b ON a.k = b.k AND a.entity = b.entity AND a.id = b.id AND a.field = b.field AND (a.side = 'entry' AND b.side = 'exit' AND a.idx = b.idx OR a.side = 'exit' AND b.side = 'entry' AND b.idx = a.idx + 1))
SELECT k AS novel_id, 'boundary:c' || li || ':c' || ri || ':' || entity || ':' || id || ':' || field AS issue_id, lv AS left_value, rv AS right_value FROM j WHERE replace(lower(lv), ' ', '') <> replace(lower(rv), ' ', '')""")
def boundary_issues_of_lines(spark, sf_dir):
    """F-15, J-10, K-04, T9."""
    s = derived(spark, sf_dir, STATES)
    place = F.when(F.col("a") == 0, "").when(F.col("a") == 1, "The Yard").when(F.col("a") == 2, "the yard").otherwise("street")
    left = F.when(F.col("b") == 0, "theyard").when(F.col("b") == 1, "house").otherwise("")
    told = F.when(F.col("c") == 0, F.array().cast("array<string>"))
    knows = told.otherwise(F.array(F.concat(F.lit("y"), F.col("c").cast("string")), F.lit("x"), F.lit("x")))
    row = lambda side, kind, i, field, value, items: F.struct(F.lit(side).alias("side"), F.lit(kind).alias("entity_type"), i.alias("entity_id"), F.lit(field).alias("field"), value.alias("value"), items.alias("items"))
    none, who = F.lit(None).cast("array<string>"), F.concat(F.lit("p"), F.col("b").cast("string"))
    many = F.array(
        row("entry", "scene", F.lit("scene"), "location", place, none),
        row("exit", "scene", F.lit("scene"), "location", left, none),
        row("entry", "character", who, "knowledge", F.lit(None).cast("string"), knows),
        row("exit", "character", who, "knowledge", F.lit(None).cast("string"), told.otherwise(F.array(F.lit("x")))),
    )
    s = s.select(F.col("k").alias("novel_id"), "idx", F.concat(F.lit("c"), F.col("idx").cast("string")).alias("chunk_id"), F.explode(many).alias("x")).select("novel_id", "idx", "chunk_id", "x.*")
    return K.boundary_issues(s).select("novel_id", "issue_id", "left_value", "right_value")


ISSUES = "SELECT o_custkey AS novel_id, o_orderkey AS ord, 'i' || o_orderkey AS issue_id, CASE o_orderkey % 3 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'continuous' ELSE 'state_change' END AS decision FROM orders"


@query(f"SELECT novel_id, issue_id, 'conflict_boundary_' || {PAD.format('row_number() OVER (PARTITION BY novel_id ORDER BY ord)')} AS conflict_id FROM ({ISSUES}) i WHERE decision = 'unresolved'")
def residual_conflicts_of_orders(spark, sf_dir):
    """F-20."""
    i = derived(spark, sf_dir, ISSUES)
    return P.residual_conflicts(i.select("issue_id", "decision"), i.drop("decision")).select("novel_id", "issue_id", "conflict_id")


KINDS = ("boundary", "fact", "identity", "timeline", "open_reference")
NUMBERED = "SELECT o_custkey AS novel_id, 'c' || o_orderkey AS conflict_id, o_orderkey % 5 AS part FROM orders"


@query(f"""WITH c AS (SELECT novel_id, conflict_id, CASE part WHEN 0 THEN 'boundary' WHEN 1 THEN 'fact' WHEN 2 THEN 'identity' WHEN 3 THEN 'timeline' ELSE 'open_reference' END AS kind, CASE part WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 0 THEN 3 ELSE 4 END AS place FROM ({NUMBERED}) n)
SELECT novel_id, row_number() OVER (PARTITION BY novel_id ORDER BY place, conflict_id)::BIGINT AS ord, kind, conflict_id FROM c""")
def conflict_list_of_orders(spark, sf_dir):
    """F-21."""
    c = derived(spark, sf_dir, NUMBERED)
    return P.conflict_list({k: c.where(F.col("part") == i).select("novel_id", "conflict_id") for i, k in enumerate(KINDS)}).select("novel_id", L("ord"), "kind", "conflict_id")


LOOSE = f"SELECT novel_id, CASE WHEN e % 2 = 0 THEN 'The ' || kind ELSE 'the' || kind END AS text, CASE v % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b,a' WHEN 2 THEN 'a,b' ELSE '' END AS who, e AS first FROM ({EVENTS}) x"


@query(f"""WITH r AS (SELECT novel_id, lower(replace(text, ' ', '')) AS text, CASE who WHEN 'b,a' THEN 'a,b' ELSE who END AS who, first FROM ({LOOSE}) x), g AS (SELECT novel_id, text, who, count(*)::BIGINT AS n, min(first) AS first FROM r GROUP BY ALL)
SELECT novel_id, 'conflict_open_reference_' || {PAD.format('row_number() OVER (PARTITION BY novel_id ORDER BY first, text)')} AS id, text, who AS candidates, n FROM g""")
def open_references_of_events(spark, sf_dir):
    """F-20."""
    r = derived(spark, sf_dir, LOOSE).withColumn("candidates", F.filter(F.split("who", ","), lambda x: x != ""))
    return K.open_references(r).withColumn("text", T.norm_text(F.col("text")))


NAMES = "SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) || ' ' END || c_nationkey || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ' no ' || (c_custkey % 300) END AS name FROM customer"


@query(f"WITH n AS (SELECT id, lower(replace(name, ' ', '')) AS name FROM ({NAMES}) x) SELECT name, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM n GROUP BY name HAVING count(DISTINCT id) > 1")
def name_collisions(spark, sf_dir):
    """J-12, F-24."""
    return K.alias_collisions(derived(spark, sf_dir, NAMES))


# A-07 .. A-09, F-11, F-12: an order's lines are one character, told by its parts.
MEMBERS = "SELECT 'char_' || l_orderkey AS canonical_id, 'n' || min(l_partkey) % 3 AS name, 'a' || min(l_suppkey) % 4 AS alias, CASE WHEN min(l_partkey) % 2 = 0 THEN '' ELSE 'seen at ' || l_linenumber END AS description, CASE WHEN max(l_partkey) % 11 = 0 THEN 'uncertain' ELSE 'same' END AS decision, l_linenumber AS first FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(f"""WITH m AS ({MEMBERS}), f AS (SELECT canonical_id, arg_min(name, first) AS name, arg_min(description, first) FILTER (description <> '') AS description, CASE WHEN bool_or(decision = 'uncertain') THEN 'provisional' ELSE 'confirmed' END AS status FROM m GROUP BY 1),
a AS (SELECT DISTINCT canonical_id, name AS x FROM m UNION SELECT canonical_id, alias FROM m)
SELECT f.canonical_id, f.name, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM a WHERE a.canonical_id = f.canonical_id AND a.x <> f.name), '') AS aliases, description, status FROM f""")
def characters_of_lines(spark, sf_dir):
    """F-11, A-07, A-08."""
    m = derived(spark, sf_dir, MEMBERS).withColumn("aliases", F.array("alias"))
    return I.build_characters(m).withColumn("aliases", F.array_join("aliases", ","))


FIELDS = "SELECT 'm' || l_partkey AS id, 'loc' || (l_suppkey % 3) AS field, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'Yard' WHEN 2 THEN 'yard ' ELSE 'house' END AS value FROM lineitem"
MAPPED = "SELECT 'm' || p_partkey AS member_id, 'char_' || (p_partkey % 500) AS canonical_id FROM part WHERE p_partkey % 3 > 0"


@query(f"""WITH r AS (SELECT coalesce(canonical_id, id) AS id, field, nullif(value, '') AS value FROM ({FIELDS}) f LEFT JOIN ({MAPPED}) m ON id = member_id)
SELECT id, field, min(value) AS value, count(DISTINCT lower(replace(value, ' ', ''))) > 1 AS ambiguous FROM r GROUP BY id, field""")
def canonical_fields(spark, sf_dir):
    """F-12, A-09, A-14, J-02."""
    return I.merge_scalars(I.rewrite(derived(spark, sf_dir, FIELDS), derived(spark, sf_dir, MAPPED), ["id"]), ["id", "field"], "value")


HELD_BY = f"SELECT novel_id, CASE WHEN e % 3 = 0 THEN 'character' ELSE 'object' END AS entity_type, kind AS entity_id, CASE e % 4 WHEN 0 THEN 'holderCharacterId' WHEN 1 THEN 'location' ELSE 'state' END AS field, CASE WHEN v % 5 = 0 THEN '' ELSE 'w' || v % 7 END AS value, e AS first FROM ({EVENTS}) x WHERE e % 2 = 0"
TOLD_OF = f"SELECT novel_id, CASE WHEN e % 3 = 0 THEN 'character' ELSE 'object' END AS kind, kind AS subject_id, CASE e % 5 WHEN 0 THEN 'Holder' WHEN 1 THEN 'holder_location' WHEN 2 THEN '位置' WHEN 3 THEN '持有者' ELSE 'mark' END AS predicate, 'w' || v % 7 AS value, e AS first FROM ({EVENTS}) x WHERE e % 2 = 1"


@query(f"""WITH r AS (SELECT novel_id, entity_id AS id, first, CASE field WHEN 'holderCharacterId' THEN 'h' WHEN 'location' THEN 'l' ELSE 's' END AS what, nullif(value, '') AS value FROM ({HELD_BY}) b WHERE entity_type = 'object'
UNION ALL SELECT novel_id, subject_id, first, CASE predicate WHEN 'Holder' THEN 'h' WHEN '持有者' THEN 'h' WHEN 'mark' THEN 's' ELSE 'l' END, CASE predicate WHEN 'mark' THEN 'mark:' || value ELSE value END FROM ({TOLD_OF}) f WHERE kind = 'object')
SELECT novel_id, id, {', '.join(f"coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (what = '{w[0]}'), '') AS {w}" for w in ('holders', 'locations', 'states'))}, min(first) AS first FROM r GROUP BY novel_id, id""")
def objects_of_events(spark, sf_dir):
    """A-15."""
    o = I.object_candidates(derived(spark, sf_dir, HELD_BY), derived(spark, sf_dir, TOLD_OF))
    return o.select("novel_id", "id", *(F.array_join(c, ",").alias(c) for c in ("holders", "locations", "states")), "first")


LOCAL = "SELECT DISTINCT 'k' || l_orderkey AS chunk_id, CASE WHEN l_linenumber % 2 = 0 THEN 'k' || l_orderkey || '::i' || l_linenumber ELSE 'i' || l_linenumber END AS id, 'i' || (l_linenumber - 1) AS other FROM lineitem"


@query(f"SELECT CASE WHEN contains(id, '::') THEN id ELSE chunk_id || '::' || id END AS id, chunk_id || '::' || other AS others FROM ({LOCAL}) l")
def local_ids_of_lines(spark, sf_dir):
    """F-01."""
    rows = derived(spark, sf_dir, LOCAL).withColumn("others", F.array("other"))
    return I.scope(rows, ["id", "others"]).select("id", F.array_join("others", ",").alias("others"))


# H-13, H-14: headings of an order: its lines, with a role by part.
PICKS = "SELECT l_orderkey AS novel_id, l_linenumber AS n, CASE min(l_partkey) % 4 WHEN 0 THEN 'volume' WHEN 1 THEN 'chapter' WHEN 2 THEN 'section' ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'section' ELSE 'toc' END END AS role FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(f"""WITH p AS ({PICKS}), l AS (SELECT p.*, (SELECT max(q.n) FROM p q WHERE q.novel_id = p.novel_id AND q.n < p.n AND q.role = 'volume') AS v, (SELECT max(q.n) FROM p q WHERE q.novel_id = p.novel_id AND q.n < p.n AND q.role = 'chapter') AS c FROM p)
SELECT novel_id, n, role, CASE role WHEN 'chapter' THEN v WHEN 'section' THEN CASE WHEN c IS NOT NULL AND (v IS NULL OR c > v) THEN c ELSE v END END AS parent FROM l""")
def heading_parents_of_lines(spark, sf_dir):
    """H-13, W-05."""
    return H.parents(derived(spark, sf_dir, PICKS)).select("novel_id", "n", "role", "parent")


@query(f"WITH p AS ({PICKS}) SELECT novel_id, n, CASE WHEN role = 'section' AND EXISTS (SELECT 1 FROM p q WHERE q.novel_id = p.novel_id AND q.role = 'chapter') THEN 'hint' ELSE 'boundary' END AS kind FROM p WHERE role <> 'toc'")
def boundaries_of_lines(spark, sf_dir):
    """H-14."""
    return H.boundaries(derived(spark, sf_dir, PICKS))


SAID = "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_partkey % 6 WHEN 0 THEN '位于' WHEN 1 THEN 'is-alive' WHEN 2 THEN 'Owner' WHEN 3 THEN 'colour' WHEN 4 THEN 'health_status' ELSE 'Currently-At' END AS p, CASE WHEN l_suppkey % 2 = 0 THEN 'constraint' ELSE 'Fact' END AS kind, CASE l_suppkey % 3 WHEN 0 THEN '全 书' WHEN 1 THEN ' A b' ELSE 'story' END AS subject, CASE WHEN l_linenumber % 2 = 0 THEN 'Bo b' END AS view FROM lineitem"


@query(f"""WITH s AS (SELECT *, CASE p WHEN '位于' THEN 'current_location' WHEN 'Currently-At' THEN 'current_location' WHEN 'is-alive' THEN 'life_status' WHEN 'Owner' THEN 'holder' WHEN 'health_status' THEN 'physical_state' ELSE 'colour' END AS canonical FROM ({SAID}) x)
SELECT k, n, canonical, lower(kind) || ':' || lower(replace(subject, ' ', '')) || ':' || canonical || ':' || coalesce('bob', '') AS key, CASE WHEN kind = 'constraint' AND subject IN ('全 书', 'story') THEN 'global:story' ELSE subject END AS canonical_subject FROM s WHERE view IS NOT NULL
UNION ALL SELECT k, n, canonical, lower(kind) || ':' || lower(replace(subject, ' ', '')) || ':' || canonical || ':', CASE WHEN kind = 'constraint' AND subject IN ('全 书', 'story') THEN 'global:story' ELSE subject END FROM s WHERE view IS NULL""")
def fact_keys_of_lines(spark, sf_dir):
    """X-10, X-11, P-11."""
    s = derived(spark, sf_dir, SAID)
    return s.select("k", "n", T.canonical_predicate(F.col("p")).alias("canonical"), T.fact_key(F.col("kind"), F.col("subject"), F.col("p"), F.col("view")).alias("key"), R.global_subject(F.col("kind"), F.col("subject")).alias("canonical_subject"))


# The model boundary: an answer an order.
USED = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{"input_tokens":' || o_custkey || ',"output_tokens":5}' WHEN 1 THEN '{"prompt_tokens":' || o_custkey || ',"completion_tokens":3}' WHEN 2 THEN '{"input_tokens":1,"output_tokens":2,"total_tokens":' || o_custkey || '}' ELSE '{}' END AS used, o_custkey AS c FROM orders"""


@query(f"""SELECT id, CASE id % 4 WHEN 2 THEN 1 WHEN 3 THEN NULL ELSE c END::BIGINT AS input, CASE id % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 2 END::BIGINT AS output, CASE id % 4 WHEN 0 THEN c + 5 WHEN 1 THEN c + 3 WHEN 2 THEN c END::BIGINT AS total FROM ({USED}) u""")
def usage_of_answers(spark, sf_dir):
    """S-13."""
    return derived(spark, sf_dir, USED).select("id", *(c.alias(a) for a, c in M.usage(F.col("used")).items()))


FAILED = "SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 402 WHEN 4 THEN 404 WHEN 5 THEN 503 WHEN 6 THEN 400 WHEN 7 THEN 418 WHEN 8 THEN 400 ELSE 500 END AS status, CASE o_orderkey % 10 WHEN 3 THEN 'Insufficient balance' WHEN 6 THEN 'Content_Filter hit' WHEN 8 THEN 'Rate limit' WHEN 9 THEN 'forbidden zone' ELSE o_orderstatus END AS raw FROM orders"


@query(f"SELECT id, CASE id % 10 WHEN 0 THEN 'auth' WHEN 1 THEN 'permission' WHEN 2 THEN 'rate' WHEN 3 THEN 'quota' WHEN 4 THEN 'model' WHEN 5 THEN 'server' WHEN 6 THEN 'filter' WHEN 7 THEN 'other' WHEN 8 THEN 'rate' ELSE 'permission' END AS kind FROM ({FAILED}) f")
def errors_of_answers(spark, sf_dir):
    """S-14."""
    return derived(spark, sf_dir, FAILED).select("id", M.error_kind(F.col("status"), F.col("raw")).alias("kind"))


ANSWERED = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{"status":"' || o_orderstatus || '","n":' || o_custkey || '}' WHEN 1 THEN 'so {"status":"' || o_orderstatus || '","n":' || o_custkey || '} it is' WHEN 2 THEN '{"status":' ELSE 'none' END AS raw, o_orderstatus AS s, o_custkey AS c FROM orders"""


@query(f"SELECT id, CASE WHEN id % 4 < 2 THEN s ELSE 'fallback' END AS status, CASE WHEN id % 4 < 2 THEN c ELSE 0 END::BIGINT AS n FROM ({ANSWERED}) a")
def parsed_answers(spark, sf_dir):
    """K-03."""
    v = M.safe_parse(F.col("raw"), "struct<status:string,n:long>", F.struct(F.lit("fallback").alias("status"), F.lit(0).cast("long").alias("n")))
    return derived(spark, sf_dir, ANSWERED).select("id", v.alias("v")).select("id", "v.status", "v.n")


ASKED = "SELECT c_custkey AS k, 'REGION_' || (c_nationkey % 8) AS id FROM customer"
OFFERED = "SELECT r_regionkey AS ord, 'REGION_' || r_regionkey AS id, 'served by ' || r_regionkey AS label FROM region"


@query(f"SELECT k, coalesce(label, (SELECT arg_max(label, ord) FROM ({OFFERED}) o)) AS label FROM ({ASKED}) a LEFT JOIN ({OFFERED}) o ON o.id = a.id")
def providers_of_customers(spark, sf_dir):
    """S-16, K-07."""
    a = derived(spark, sf_dir, ASKED)
    ids = M.with_default(a.select("id").distinct(), derived(spark, sf_dir, OFFERED), "id", "label")
    return a.join(ids, "id").select("k", "label")


# S-11, I-07: a conversation is a stream of events in pieces of 29 characters; its last line has no end yet.
STREAMED = """SELECT conv_id, turn, '{"progress":{"turn":' || turn || ',"role":"' || role || '"}}' AS event FROM conversations"""


def pieces(spark, sf_dir):
    e = derived(spark, sf_dir, STREAMED)
    line = F.concat(F.lit("data: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "event"))), lambda x: x["event"]), "\n\ndata: "))
    end = F.concat(F.lit('\n\ndata: {bad}\n\ndata: {"done":true,"scenes":'), F.count("*").cast("string"), F.lit(',"screenplay":{"characters":[1,2]},"validation":{"errors":[]},"repaired":true}\n\ndata: {"late":1}'))
    body = e.groupBy(F.col("conv_id").alias("stream")).agg(F.concat(line, end).alias("body"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / 29).cast("int")), lambda i: F.struct(i.alias("seq"), F.substring("body", i * 29 + 1, F.lit(29)).alias("piece")))
    return body.select("stream", F.explode(cut).alias("x")).select("stream", "x.seq", "x.piece")


@query(f"SELECT conv_id AS stream, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, event) - 1)::BIGINT * 2 AS line_no, event FROM ({STREAMED}) s UNION ALL SELECT conv_id, (count(*) * 2 + 2)::BIGINT, '{{\"done\":true,\"scenes\":' || count(*) || ',\"screenplay\":{{\"characters\":[1,2]}},\"validation\":{{\"errors\":[]}},\"repaired\":true}}' FROM ({STREAMED}) s GROUP BY conv_id")
def events_from_pieces(spark, sf_dir):
    """S-11."""
    return M.reassembled(pieces(spark, sf_dir)).select("stream", L("line_no"), "event")


@query(f"SELECT conv_id AS stream, count(*)::BIGINT AS scenes, 2::BIGINT AS characters, true AS repaired, 0::BIGINT AS errors FROM ({STREAMED}) s GROUP BY conv_id")
def done_of_pieces(spark, sf_dir):
    """I-07."""
    return M.done_stats(M.reassembled(pieces(spark, sf_dir)))


# G-09, P-14, R-01, P-17, S-08: a conversation is a screenplay of a scene a turn.
SCENES = "SELECT DISTINCT conv_id AS project, turn AS scene, turn + 1 AS number, CASE WHEN turn % 3 = 0 THEN 'INT' WHEN turn % 3 = 1 THEN 'EXT' ELSE 'cellar' END AS setting, 'place ' || turn AS location, CASE WHEN turn % 2 = 0 THEN 'NIGHT' ELSE 'noon' END AS time FROM conversations"
SPOKEN = """SELECT conv_id AS project, turn AS scene, 0 AS pos, 0 AS line_pos, 'action' AS type, min(substr(text, 1, 9)) AS text, CAST(NULL AS STRING) AS who, CAST(NULL AS STRING) AS mode, CAST(NULL AS STRING) AS aside, CAST(NULL AS STRING) AS line FROM conversations GROUP BY conv_id, turn
UNION ALL SELECT conv_id, turn, 1, 0, 'dialogue', NULL, min(role), CASE WHEN turn % 3 = 1 THEN 'voiceover' WHEN turn % 3 = 2 THEN 'off_screen' ELSE 'in_scene' END, CASE WHEN turn % 2 = 0 THEN 'softly' ELSE '' END, min(substr(text, 3, 7)) FROM conversations GROUP BY conv_id, turn
UNION ALL SELECT conv_id, turn, 2, 0, 'transition', 'cut', NULL, NULL, NULL, NULL FROM conversations GROUP BY conv_id, turn"""


@query(f"""WITH s AS ({SCENES}), e AS ({SPOKEN}), l AS (SELECT project, scene, string_agg(CASE type WHEN 'action' THEN '△ ' || text WHEN 'transition' THEN text ELSE CASE who WHEN 'user' THEN 'The User' ELSE who END || CASE mode WHEN 'voiceover' THEN '（画外）' WHEN 'off_screen' THEN '（画外音）' ELSE '' END || CASE WHEN aside <> '' THEN '（' || aside || '）' ELSE '' END || '：' || line END, chr(10) ORDER BY pos) AS body FROM e GROUP BY project, scene),
t AS (SELECT project, string_agg('第' || number || '场　' || CASE time WHEN 'NIGHT' THEN '夜' ELSE time END || '　' || CASE setting WHEN 'INT' THEN '内' WHEN 'EXT' THEN '外' ELSE setting END || '　' || location || chr(10) || body, chr(10) || chr(10) ORDER BY scene) AS text FROM s JOIN l USING (project, scene) GROUP BY project)
SELECT project, md5('title ' || project || chr(10) || chr(10) || text || chr(10)) AS digest FROM t""")
def render_conversations(spark, sf_dir):
    """R-01, P-17, S-08."""
    s = derived(spark, sf_dir, SCENES)
    e = derived(spark, sf_dir, SPOKEN).withColumnsRenamed({"who": "character", "aside": "parenthetical"})
    p = s.select("project").distinct().withColumn("title", F.concat(F.lit("title "), F.col("project").cast("string")))
    text = S.render(p, p.select("project", F.lit("user").alias("id"), F.lit("The User").alias("name")), s, e)
    return text.select("project", F.md5(F.col("text").cast("binary")).alias("digest"))


CAST = "SELECT l_orderkey AS project, l_linenumber AS ord, 'c' || l_linenumber AS id, 'N' || min(l_partkey) AS name, CASE WHEN min(l_suppkey) % 2 = 0 THEN 'x' || min(l_suppkey) END AS alias, CASE WHEN min(l_partkey) % 3 = 0 THEN 'tall' ELSE '' END AS description FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(f"""SELECT project, '[' || string_agg('{{"id":"' || id || '","name":"' || name || '"' || CASE WHEN alias IS NOT NULL THEN ',"aliases":["' || alias || '"]' ELSE '' END || CASE WHEN description <> '' THEN ',"description":"' || description || '"' ELSE '' END || '}}', ',' ORDER BY ord) || ']' AS "cast" FROM ({CAST}) c GROUP BY project""")
def cast_of_lines(spark, sf_dir):
    """G-09, P-14."""
    c = derived(spark, sf_dir, CAST)
    return S.cast_section(c.withColumn("aliases", F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(F.array().cast("array<string>"))))


# G-04, G-05: a project an order, a batch of two scenes; those of every third lack a place, and every other of their repairs can't be read.
HEAD = """'{{"id":"z","heading":{{"setting":"INT","location":"' || {} || '","time":"DAY"}},"elements":[{{"type":"transition","text":"cut"}}]}}'"""


@query("SELECT o_orderkey AS project, CASE WHEN o_orderkey % 6 = 3 THEN 2 ELSE 0 END::BIGINT AS errors, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 2 END::BIGINT AS warnings, o_orderkey % 3 = 0 AS repaired, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 2 END::BIGINT AS scenes FROM orders")
def repaired_projects(spark, sf_dir):
    """G-04, G-05."""
    good, own = HEAD.replace("{{", "{").replace("}}", "}").replace("{}", "'yard'", 1), HEAD.replace("{{", "{").replace("}}", "}").replace("{}", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'yard' END", 1)
    b = derived(spark, sf_dir, f"""SELECT o_orderkey AS project, 0 AS ord, '{{"scenes":[' || {own} || ',' || {own} || ']}}' AS json FROM orders""", "orders")
    p = b.select("project", F.lit("T").alias("title"))
    c = p.select("project", F.lit(0).alias("ord"), F.lit("x").alias("id"), F.lit("X").alias("name"), F.array().cast("array<string>").alias("aliases"))
    new = derived(spark, sf_dir, f"""SELECT o_orderkey AS project, CASE WHEN o_orderkey % 2 = 0 THEN '{{"scenes":[' || {good} || ']}}' ELSE 'sorry' END AS json FROM orders""", "orders")
    got = S.generate(p, c, b, lambda errors: errors.select("project").distinct().join(new, "project"))["status"]
    return got.select("project", "errors", "warnings", "repaired", L("scenes"))


@query("SELECT event_type AS key, user_id, count(*)::BIGINT AS n, CASE WHEN bool_or(value > 60) THEN 'source_fact' ELSE 'uncertain' END AS status FROM events GROUP BY ALL")
def upgraded_status(spark, sf_dir):
    """A-08, F-05: certain as soon as one fact of a key is."""
    e = read(spark, sf_dir, "events", F.col("event_type").alias("key"), "user_id", "value")
    return e.groupBy("key", "user_id").agg(F.count("*").alias("n"), K.upgrade_status(F.when(F.col("value") > 60, "source_fact").otherwise("uncertain")).alias("status"))


# F-02: a novel's characters, objects and threads, each by kind of event.
PEOPLE = f"SELECT novel_id, min(e) AS ord, 'c::' || kind AS id, 'The ' || kind AS name, min(v) AS first FROM ({EVENTS}) x GROUP BY novel_id, kind"
THINGS = f"SELECT novel_id, 'o::' || (v % 6) AS id, min(e) AS first FROM ({EVENTS}) x GROUP BY novel_id, v % 6"
PLOTS = f"SELECT novel_id, min(e) AS ord, 't::' || (e % 4) AS id, 'plot ' || (e % 4) AS summary, max(v) AS first FROM ({EVENTS}) x GROUP BY novel_id, e % 4"


@query(f"""WITH a AS (SELECT novel_id, 'char' AS entity, 0 AS k, ord, id, name, first FROM ({PEOPLE}) p UNION ALL SELECT novel_id, 'object', 1, row_number() OVER (PARTITION BY novel_id ORDER BY first, id), id, id, first FROM ({THINGS}) o UNION ALL SELECT novel_id, 'thread', 2, ord, id, summary, first FROM ({PLOTS}) t)
SELECT novel_id, entity, row_number() OVER (PARTITION BY novel_id ORDER BY k, ord, id)::BIGINT AS ord, id, name, first::BIGINT AS first FROM a""")
def candidates_of_events(spark, sf_dir):
    """F-02, A-05."""
    got = I.identity_candidates(*(derived(spark, sf_dir, x) for x in (PEOPLE, THINGS, PLOTS)))
    return got.select("novel_id", "entity", L("ord"), "id", "name", "first")


# F-03: a plan an order for four candidates, spoiled by key.
PLAN = """('{"groups":[{"memberIds":["a"],"canonicalName":"A","aliases":[],"decision":"same"},{"memberIds":["b"],"canonicalName":"B","aliases":[],"decision":"same"}],"objectGroups":[{"memberIds":["key"],"canonicalName":"K","decision":"same"}],"threadGroups":[{"memberIds":["t"],"canonicalSummary":"T","decision":"uncertain"}]}')"""
PLAN_FAULTS = [
    (1, "'no json'", None, [("", "invalid_json", "")]),
    (2, '"groups":', "'\"other\":'", [("char", "missing_list", "groups")]),
    (3, '"objectGroups":', "'\"other\":'", [("object", "missing_list", "objectGroups")]),
    (4, '"threadGroups":', "'\"other\":'", [("thread", "missing_list", "threadGroups")]),
    (5, '"memberIds":["a"]', "'\"memberIds\":[\"a\",\"a\"]'", [("char", "duplicate_member", "a")]),
    (6, '"memberIds":["a"]', "'\"memberIds\":[\"a\",\"zz\"]'", [("char", "unknown_member", "zz")]),
    (7, '"memberIds":["b"]', "'\"memberIds\":[]'", [("char", "members_empty", "1"), ("char", "missing_member", "b")]),
    (8, '"canonicalName":"A"', "'\"canonicalName\":\" \"'", [("char", "name_empty", "0")]),
    (9, '"decision":"uncertain"', "'\"decision\":\"maybe\"'", [("thread", "decision", "0")]),
    (10, '"aliases":[]', "'\"aliases\":[null]'", [("char", "aliases", "0"), ("char", "aliases", "1")]),
    (11, '"memberIds":["key"]', "'\"memberIds\":[\"a\"]'", [("object", "unknown_member", "a"), ("object", "missing_member", "key")]),
]
PLAN_ROWS = ", ".join(f"({f}, '{e}', '{r}', '{a}')" for f, _, _, found in PLAN_FAULTS for e, r, a in found)


@query(f"""SELECT o_orderkey AS novel_id, 0 AS page, entity, rule, "at" FROM orders JOIN (VALUES {PLAN_ROWS}) v(f, entity, rule, "at") ON o_orderkey % 17 = v.f""")
def plan_errors_of_orders(spark, sf_dir):
    """F-03, U-06."""
    cases = " ".join(f"WHEN o_orderkey % 17 = {f} THEN {old}" if new is None else f"WHEN o_orderkey % 17 = {f} THEN replace({PLAN}, '{old}', {new})" for f, old, new, _ in PLAN_FAULTS)
    raw = derived(spark, sf_dir, f"SELECT o_orderkey AS novel_id, 0 AS page, CASE {cases} ELSE {PLAN} END AS raw FROM orders", "orders")
    four = F.array(*(F.struct(F.lit(e).alias("entity"), F.lit(i).alias("id")) for e, i in (("char", "a"), ("char", "b"), ("object", "key"), ("thread", "t"))))
    return I.parse_plan(raw, raw.select("novel_id", "page", F.explode(four).alias("x")).select("novel_id", "page", "x.*"))[1]


# F-19: a customer's orders are changes of one fact, each of the one before; some are of another key, some aren't asked for.
CHANGES = "SELECT o_custkey AS novel_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, o_orderkey % 13 = 5 AS strange, o_orderkey % 17 = 3 AS unasked FROM orders"


@query(f"""WITH c AS ({CHANGES}), a AS (SELECT *, min(CASE WHEN strange OR unasked THEN 0 ELSE 1 END) OVER (PARTITION BY novel_id ORDER BY k) = 1 AS ok FROM c), n AS (SELECT *, coalesce(lead(ok) OVER (PARTITION BY novel_id ORDER BY k), false) AS more FROM a)
SELECT novel_id, 'f0' AS id, NULL AS supersedes, CASE WHEN bool_or(k = 1 AND ok) THEN 'f1' END AS superseded_by FROM a GROUP BY novel_id UNION ALL SELECT novel_id, 'f' || k, 'f' || (k - 1), CASE WHEN more THEN 'f' || (k + 1) END FROM n WHERE ok""")
def state_changes_of_orders(spark, sf_dir):
    """F-19: a chain of changes goes on until one doesn't apply."""
    c = derived(spark, sf_dir, CHANGES)
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    facts = c.select("novel_id").distinct().select("novel_id", F.lit("f0").alias("id"), F.lit("loc").alias("key"), F.lit("v0").alias("value"), F.lit(None).cast("string").alias("superseded_by"))
    pair = c.select("novel_id", F.col("k").alias("ord"), name(F.col("k") - 1).alias("existing_id"), name(F.col("k")).alias("incoming_id"), "strange", "unasked")
    conflicts = pair.select("novel_id", F.concat(F.lit("x"), "incoming_id").alias("conflict_id"), "existing_id", "incoming_id", F.when(F.col("strange"), "own").otherwise("loc").alias("key"), F.col("incoming_id").alias("value"))
    facts, conflicts = (d.withColumn("novel_id", F.col("novel_id").cast("string")) for d in (facts, conflicts))
    asked = pair.where("not unasked").select(F.col("novel_id").cast("string").alias("novel_id"), "ord", "existing_id", "incoming_id")
    return P.apply_state_changes(facts, conflicts, asked)[0].select(F.col("novel_id").cast("long").alias("novel_id"), "id", "supersedes", "superseded_by")


HINTED = "SELECT DISTINCT l_orderkey AS novel_id, l_suppkey % 9 AS n FROM lineitem"
NUMBERED_LINES = "SELECT DISTINCT l_orderkey AS novel_id, l_linenumber AS n FROM lineitem"


@query(f"SELECT novel_id, 'unknown_hint' AS rule, CAST(CAST(n AS DOUBLE) AS STRING) AS \"at\" FROM ({HINTED}) h WHERE NOT EXISTS (SELECT 1 FROM ({NUMBERED_LINES}) p WHERE p.novel_id = h.novel_id AND p.n = h.n)")
def unknown_hints_of_lines(spark, sf_dir):
    """C-10."""
    from foliant.operators.structure import split_hints

    return split_hints(derived(spark, sf_dir, HINTED), derived(spark, sf_dir, NUMBERED_LINES))[1]


# F-16: an order is an entity, its lines facts of where it is and changes of that.
PLACED = "SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem"


@query(f"""WITH p AS ({PLACED}) SELECT 'i' || i.k || '/' || i.n AS issue_id, 'f' || i.k || '/' || a.n AS existing_id, 'f' || i.k || '/' || b.n AS incoming_id
FROM p i JOIN p a ON a.k = i.k AND a.n % 3 = i.n % 3 JOIN p b ON b.k = i.k AND b.n % 3 = (i.n + 1) % 3""")
def transitions_of_lines(spark, sf_dir):
    """F-16, P-12, K-05: scalar fields; other spellings of a predicate count."""
    p = derived(spark, sf_dir, PLACED)
    value = lambda n: F.concat(F.lit("Place "), (n % 3).cast("string"))
    who, at = F.concat(F.lit("p"), F.col("k").cast("string")), F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"))
    issues = p.select(F.concat(F.lit("i"), at).alias("issue_id"), F.lit("character").alias("entity_type"), who.alias("entity_id"), F.lit("location").alias("field"), value(F.col("n")).alias("exit"), value(F.col("n") + 1).alias("entry"))
    facts = p.select(F.concat(F.lit("f"), at).alias("id"), F.lit("location").alias("kind"), who.alias("subject_id"), F.when(F.col("n") % 2 == 0, "currently-at").otherwise("location").alias("predicate"), value(F.col("n")).alias("value"), F.lit("s").alias("statement"), F.lit(None).cast("string").alias("perspective_id"))
    return P.allowed_transitions(issues, facts)


# O-06, O-08: an order's lines are paragraphs, and references to two of them each.
WRITTEN = "SELECT l_orderkey AS novel_id, l_linenumber AS n, 'part ' || min(l_partkey) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(f"""WITH p AS ({WRITTEN}), r AS (SELECT novel_id, n AS pos, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY novel_id) AS total FROM p WINDOW w AS (PARTITION BY novel_id ORDER BY n)), c AS (SELECT * FROM r WHERE k IN (0, (total - 1) // 2, total - 1)),
t AS (SELECT c.novel_id, c.pos, coalesce(string_agg('¶' || p.n || ' ' || p.text, chr(10) ORDER BY p.n), '') AS t FROM c LEFT JOIN p ON p.novel_id = c.novel_id AND p.n BETWEEN c.pos AND c.pos + 1 GROUP BY ALL)
SELECT novel_id, pos, substr(t, 1, greatest(30 - coalesce(sum(length(t)) OVER (PARTITION BY novel_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT) AS snippet FROM t""")
def snippets_of_lines(spark, sf_dir):
    """O-06, O-08."""
    p = derived(spark, sf_dir, WRITTEN)
    refs = p.select("novel_id", F.lit("a").alias("id"), F.col("n").alias("pos"), F.col("n").alias("start"), (F.col("n") + 1).alias("end"))
    return I.evidence_snippets(refs, p, 30).select("novel_id", "pos", "snippet")


QUERIES, ORACLES = oracle(__name__)
