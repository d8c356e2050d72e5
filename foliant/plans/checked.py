"""Rule reports over the given tables: answers, facts, threads and screenplays are
derived from orders and their lines, with a fault that depends on the order's
key.  The derivations are SQL that Spark and the oracle both read; what is wrong
is found by the operators on one side and by statements over the derived rows on
the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import rules as R
from foliant.operators import screenplay as S
from foliant.plans.base import derived, oracle, query
from foliant.sources.stage import staged

#: One row a line number of an order, with the number of the order's fault.
LINES = "SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_orderkey % 29 AS f FROM lineitem"


def union(statements: list[str]) -> str:
    return " UNION ALL ".join(statements)


# Screenplays: an order is a project, a line number a scene with its character.
SCREENPLAY = {
    "p": "SELECT o_orderkey AS project, CASE WHEN o_orderkey % 29 = 1 THEN '  ' ELSE 'T' END AS title FROM orders",
    "c": f"SELECT k AS project, n - 1 AS ord, CASE WHEN f = 2 AND n < 3 THEN '' WHEN f = 3 THEN 'same' ELSE 'c' || n END AS id, CASE WHEN f = 4 THEN ' ' ELSE 'N' || n || 'x' END AS name FROM ({LINES}) b",
    "s": f"SELECT k AS project, n AS scene, CASE WHEN f = 5 THEN '' ELSE 's' || n END AS id, CASE WHEN f <> 6 THEN n END AS number, CASE WHEN f = 7 THEN '室内' ELSE 'INT' END AS setting, CASE WHEN f = 8 THEN ' ' ELSE 'yard' END AS location, CASE WHEN f = 9 THEN 'NOON' ELSE 'DAY' END AS time, f <> 10 AS has_source FROM ({LINES}) b",
    "e": union([
        f"SELECT k AS project, n AS scene, 0 AS pos, 0 AS line_pos, 'action' AS type, CASE WHEN f = 11 THEN ' ' ELSE 'N' || n || 'x walks in' END AS text, CAST(NULL AS STRING) AS who, CAST(NULL AS STRING) AS line, CAST(NULL AS STRING) AS mode FROM ({LINES}) b WHERE f <> 19",
        f"SELECT k, n, 1, 0, 'dialogue', CAST(NULL AS STRING), CASE WHEN f = 12 THEN '' WHEN f = 13 THEN 'ghost' WHEN f = 21 THEN 'c' || (n + 1) ELSE 'c' || n END, CASE WHEN f = 14 THEN ' ' ELSE 'so' END, CASE WHEN f = 15 THEN 'shout' WHEN f = 22 THEN 'voiceover' END FROM ({LINES}) b WHERE f <> 19",
        f"SELECT k, n, 2, CASE WHEN f <> 17 THEN 0 END, CASE WHEN f = 16 THEN 'song' WHEN f IN (17, 18) THEN 'dual_dialogue' ELSE 'transition' END, 'cut', CASE WHEN f = 18 THEN '' END, CASE WHEN f = 18 THEN 'x' END, CAST(NULL AS STRING) FROM ({LINES}) b WHERE f <> 19",
    ]),
    "t": f"SELECT k AS project, n AS pos, CASE WHEN f = 20 THEN 's99' ELSE 's' || n END AS scene_id FROM ({LINES}) b",
}
SPOKEN = "(type = 'dialogue' OR type = 'dual_dialogue' AND line_pos IS NOT NULL)"
EMPTY = "coalesce(trim({}), '') = ''"


def _place(field: str) -> str:
    at = "'scenes[' || scene || '].elements[' || pos || ']"
    return f"CASE WHEN type = 'dual_dialogue' THEN {at}.lines[' || line_pos || '].{field}' ELSE {at}.{field}' END"


def _bad(rule: str, path: str, where: str, severity: str = "error") -> str:
    return f"SELECT project, '{rule}' AS rule, '{severity}' AS severity, {path} AS path FROM {where}"


FAULTY = union([
    _bad("title", "'meta.title'", f"p WHERE {EMPTY.format('title')}"),
    _bad("characters", "'characters'", "p WHERE project NOT IN (SELECT project FROM c)"),
    _bad("character_id", "'characters[' || ord || '].id'", f"c WHERE {EMPTY.format('id')}"),
    _bad("character_name", "'characters[' || ord || '].name'", f"c WHERE {EMPTY.format('name')}"),
    _bad("character_duplicate", "'characters[' || ord || '].id'", "(SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY ord) AS r FROM c WHERE id <> '') WHERE r > 1"),
    _bad("scenes", "'scenes'", "p WHERE project NOT IN (SELECT project FROM s)"),
    _bad("scene_id", "'scenes[' || scene || '].id'", f"s WHERE {EMPTY.format('id')}"),
    _bad("scene_number", "'scenes[' || scene || '].number'", "s WHERE number IS NULL"),
    _bad("setting", "'scenes[' || scene || '].heading.setting'", "s WHERE setting NOT IN ('INT', 'EXT', 'INT/EXT')"),
    _bad("location", "'scenes[' || scene || '].heading.location'", f"s WHERE {EMPTY.format('location')}"),
    _bad("time", "'scenes[' || scene || '].heading.time'", "s WHERE time NOT IN ('DAY', 'NIGHT', 'DUSK', 'DAWN', 'CONTINUOUS', 'LATER')"),
    _bad("empty_scene", "'scenes[' || scene || '].elements'", "s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.project = s.project AND e.scene = s.scene)", "warning"),
    _bad("source", "'scenes[' || scene || '].source'", "s WHERE NOT has_source", "warning"),
    _bad("type", "'scenes[' || scene || '].elements[' || pos || '].type'", "e WHERE type = 'song'"),
    _bad("text", "'scenes[' || scene || '].elements[' || pos || '].text'", f"e WHERE type IN ('action', 'transition') AND {EMPTY.format('text')}"),
    _bad("lines", "'scenes[' || scene || '].elements[' || pos || '].lines'", "e WHERE type = 'dual_dialogue' AND line_pos IS NULL"),
    _bad("speaker", _place("character"), f"e WHERE {SPOKEN} AND {EMPTY.format('who')}"),
    _bad("line", _place("line"), f"e WHERE {SPOKEN} AND {EMPTY.format('line')}"),
    _bad("mode", "'scenes[' || scene || '].elements[' || pos || '].mode'", "e WHERE type = 'dialogue' AND mode NOT IN ('in_scene', 'voiceover', 'off_screen')"),
    _bad("speaker_unknown", _place("character"), f"e WHERE {SPOKEN} AND who <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.project = e.project AND c.id = e.who)"),
    _bad("structure", "'structure[' || pos || '].scene_ids'", "t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.project = t.project AND s.id = t.scene_id)"),
    _bad("speaks_early", "'scenes[' || scene || '] ' || who", "early", "warning"),
])
EARLY = """n AS (SELECT c.project, c.id, min(e.scene) AS first FROM c JOIN e ON e.project = c.project AND e.type = 'action' AND trim(c.name) <> '' AND contains(e.text, c.name) GROUP BY ALL),
early AS (SELECT DISTINCT e.project, e.scene, e.who FROM e LEFT JOIN n ON n.project = e.project AND n.id = e.who WHERE e.type IN ('dialogue', 'dual_dialogue') AND e.who <> '' AND (n.first IS NULL OR n.first > e.scene))"""


@query(f"WITH {', '.join(f'{k} AS ({v})' for k, v in SCREENPLAY.items())}, {EARLY} {FAULTY}")
def screenplay_rules(spark, sf_dir):
    """Q-02, Q-03, Q-05 .. Q-08, Q-10, Q-11, Q-13 .. Q-15, Q-17, Q-19 .. Q-28."""
    p, c, s, e, t = (derived(spark, sf_dir, v) for v in SCREENPLAY.values())
    return S.violations(p, c.withColumn("aliases", F.array().cast("array<string>")), s, e.withColumnRenamed("who", "character"), t)


def spoiled(good: str, faults: list[tuple[int, str, str]], period: int, key: str) -> str:
    """SQL of a text that is ``good`` but for one replacement, by key."""
    cases = " ".join(f"WHEN {key} % {period} = {f} THEN {old}" if new is None else f"WHEN {key} % {period} = {f} THEN replace({good}, '{old}', {new})" for f, old, new in faults)
    return f"CASE {cases} ELSE {good} END"


def expected(found: list[tuple[int, str, str]], period: int, prefix: str, key: str = "o_orderkey") -> str:
    rows = ", ".join(f"({f}, '{rule}', '{path}')" for f, rule, path in found)
    return f"SELECT rule, {prefix} || path AS path FROM orders JOIN (VALUES {rows}) v(f, rule, path) ON {key} % {period} = v.f"


# Answers to chunks: an order is a chunk, ten paragraphs long.
EDGES = "'{\"start\":' || (o_orderkey * 10 + 1) || ',\"end\":' || (o_orderkey * 10 + 10) || '}'"
DELTA = f"""('{{"chunkId":"k' || o_orderkey || '","processedRange":' || {EDGES} || ',"characters":[{{"id":"lin","name":"Lin","aliases":[]}}],"newFacts":[],"timelineEvents":[],"openedThreads":[],"resolvedThreads":[],"reportedConflicts":[],"resolvedConflicts":[],"boundaryState":{{"characters":[],"objects":[],"openReferences":[]}}}}')"""
DELTA_FAULTS = [
    (1, "'no json'", None, "invalid_json", ""),
    (2, "'[1]'", None, "root", ""),
    (3, '"chunkId":"k', "'\"chunkId\":\"z'", "chunk_id", "chunkId"),
    (4, '"start":', "'\"start\":9'", "range", "processedRange"),
    (5, '"newFacts":[]', "'\"newFacts\":{}'", "list_missing", "newFacts"),
    (6, '"aliases":[]', "'\"aliases\":[\"a\",1]'", "character_aliases", "characters[0].aliases"),
    (7, '"name":"Lin"', "'\"name\":\" \"'", "character_name", "characters[0].name"),
    (8, '"aliases":[]', "'\"aliases\":[],\"description\":5'", "character_description", "characters[0].description"),
    (9, '"aliases":[]', "'\"aliases\":[],\"identityStatus\":\"x\"'", "server_field", "characters[0].identityStatus"),
    (10, '"name":"Lin"', "'\"name\":\"Other\"'", "character_renamed", "characters[0].name"),
    (11, '"newFacts":[]', "'\"newFacts\":[{\"id\":\"f\"},{\"supersededByFactId\":\"g\"}]'", "server_field", "newFacts[1].supersededByFactId"),
    (12, '"reportedConflicts":[]', "'\"reportedConflicts\":[{\"description\":\"\"}]'", "conflict_description", "reportedConflicts[0].description"),
    (13, '"boundaryState"', "'\"other\"'", "boundary_missing", "boundaryState"),
    (14, '"objects":[],', "''", "list_missing", "boundaryState.objects"),
    (15, '"openReferences":[]', "'\"openReferences\":[{\"text\":\" \",\"candidateCharacterIds\":[]}]'", "reference_text", "boundaryState.openReferences[0].text"),
    (16, '"openReferences":[]', "'\"openReferences\":[{\"text\":\"he\",\"candidateCharacterIds\":\"x\"}]'", "reference_candidates", "boundaryState.openReferences[0].candidateCharacterIds"),
    (17, '"openReferences":[]', "'\"openReferences\":[{\"text\":\"he\",\"candidateCharacterIds\":[\"lin\",\"ghost\"]}]'", "reference_unknown", "boundaryState.openReferences[0].candidateCharacterIds"),
    (18, '"objects":[],', "'\"objects\":[],\"timeLabel\":3,'", "boundary_label", "boundaryState.timeLabel"),
    (19, '"objects":[],', "'\"objects\":[],\"location\":\"' || repeat('x', 26000) || '\",'", "boundary_size", "boundaryState"),
    (20, '"newFacts":[]', "'\"newFacts\":[{\"id\":\"' || repeat('x', 200000) || '\"}]'", "too_long", ""),
    (22, '"characters":[{', "'\"people\":[{'", "list_missing", "characters"),
    (23, '"resolvedConflicts":[]', "'\"resolvedConflicts\":null'", "list_missing", "resolvedConflicts"),
]
P = 41
DELTA_ROWS = f"SELECT 'k' || o_orderkey AS chunk_id, {spoiled(DELTA, [x[:3] for x in DELTA_FAULTS], P, 'o_orderkey')} AS raw FROM orders"
SPANS = f"SELECT 'k' || o_orderkey AS chunk_id, o_orderkey * 10 + 1 AS start, o_orderkey * 10 + 10 AS stop, CASE WHEN o_orderkey % {P} = 21 THEN o_orderkey * 10 - 1 ELSE o_orderkey * 10 END AS done FROM orders"


def spans(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, SPANS).withColumnRenamed("stop", "end")


@query(expected([(f, rule, path) for f, _, _, rule, path in DELTA_FAULTS] + [(21, "continuity", "processedRange")], P, "'raw/k' || o_orderkey || '/'"))
def delta_answers(spark, sf_dir):
    """D-01 .. D-04, D-06 .. D-10, D-20, D-26, D-29, D-32 .. D-35: an answer an
    order, a fault in about half."""
    known = spark.range(1).select(F.lit("lin").alias("id"), F.lit("Lin").alias("name"))
    return R.delta_shapes(derived(spark, sf_dir, DELTA_ROWS, "orders"), spans(spark, sf_dir), known)


LOCAL = f"""('so ```json' || chr(10) || '{{"chunkId":"k' || o_orderkey || '","coreRange":' || {EDGES} || ',"characters":[{{"id":"a","name":"A","aliases":["b"]}}],"facts":[{{"id":"f"}}],"timelineEvents":[],"threadObservations":[]}}' || chr(10) || '```')"""
LOCAL_FAULTS = [
    (1, "'{\"chunkId\":'", None, "invalid_json", ""),
    (2, "'5'", None, "root", ""),
    (3, '"chunkId":"k', "'\"chunk\":\"k'", "chunk_id", "chunkId"),
    (4, '"end":', "'\"end\":1'", "range", "coreRange"),
    (5, '"facts":[{"id":"f"}]', "'\"facts\":\"f\"'", "list_missing", "facts"),
    (6, '"threadObservations":[]', "'\"threads\":[]'", "list_missing", "threadObservations"),
    (7, '"name":"A",', "''", "character_name", "characters[0].name"),
    (8, '"aliases":["b"]', "'\"aliases\":null'", "character_aliases", "characters[0].aliases"),
    (9, '"name":"A"', "'\"name\":\"A\",\"description\":[]'", "character_description", "characters[0].description"),
    (10, '{"id":"f"}', "'{\"id\":\"f\",\"supersededByFactId\":null}'", "server_field", "facts[0].supersededByFactId"),
]


@query(expected([(f, rule, path) for f, _, _, rule, path in LOCAL_FAULTS], 19, "'raw/k' || o_orderkey || '/'"))
def local_answers(spark, sf_dir):
    """L-01, L-02, L-04, L-11."""
    rows = f"SELECT 'k' || o_orderkey AS chunk_id, {spoiled(LOCAL, [x[:3] for x in LOCAL_FAULTS], 19, 'o_orderkey')} AS raw FROM orders"
    return R.local_shapes(derived(spark, sf_dir, rows, "orders"), spans(spark, sf_dir))


PLAY = """('{"characters":[{"id":"x"}],"scenes":[{"heading":{},"elements":[{"type":"action"}]}]}')"""
PLAY_FAULTS = [
    (1, "'[]'", None, "root", "(root)"),
    (2, "'oops'", None, "root", "(root)"),
    (3, '{"id":"x"}', "'\"y\"'", "character", "characters[0]"),
    (4, '"scenes":[', "'\"scenes\":[5,'", "scene", "scenes[0]"),
    (5, '"heading":{}', "'\"heading\":[]'", "heading", "scenes[0].heading"),
    (6, '"elements":[{"type":"action"}]', "'\"elements\":{}'", "elements", "scenes[0].elements"),
    (7, '[{"type":"action"}]', "'[{\"type\":\"action\"},\"e\"]'", "element", "scenes[0].elements[1]"),
    (8, '"heading":{},', "''", "heading", "scenes[0].heading"),
]


@query(expected([(f, rule, path) for f, _, _, rule, path in PLAY_FAULTS], 13, "''").replace("SELECT rule", "SELECT o_orderkey AS project, rule"))
def screenplay_answers(spark, sf_dir):
    """Q-01, Q-04, Q-09, Q-12, Q-16, Q-18."""
    rows = f"SELECT o_orderkey AS project, {spoiled(PLAY, [x[:3] for x in PLAY_FAULTS], 13, 'o_orderkey')} AS json FROM orders"
    return S.shape_violations(derived(spark, sf_dir, rows))


# Facts: a line number is a fact; each supersedes the one before it.
FACTS = f"""SELECT 'k' || k AS chunk_id, CASE WHEN f = 1 AND n = 2 THEN '' WHEN f = 2 AND n = 3 THEN 'f2' ELSE 'f' || n END AS id, n AS pos, CASE WHEN f = 3 THEN 'mood' WHEN f = 4 THEN 'constraint' WHEN f = 5 THEN 'object' ELSE 'location' END AS kind,
CASE WHEN f = 6 THEN ' ' WHEN f = 7 THEN 'ghost' WHEN f = 8 AND n > 3 THEN 'b' WHEN f = 4 AND n > 2 THEN '全书' ELSE 'a' END AS subject_id, CASE WHEN f = 9 THEN '' WHEN f = 10 AND n = 2 THEN 'currently_at' ELSE 'location' END AS predicate, CASE WHEN f = 11 THEN ' ' ELSE 'v' || n END AS value,
CASE WHEN f = 12 THEN '' ELSE 'it is so' END AS statement, CASE WHEN f = 13 THEN 'sure' ELSE 'source_fact' END AS status, CASE WHEN f = 14 THEN 'zz' WHEN f = 15 THEN 'b' END AS perspective_id,
CASE WHEN n = 1 THEN NULL WHEN f = 16 THEN 'f' || (n + 1) WHEN f = 17 THEN 'f1' ELSE 'f' || (n - 1) END AS supersedes, CASE WHEN f = 18 THEN 'whim' WHEN f = 19 THEN NULL WHEN n = 1 AND f <> 20 THEN NULL ELSE 'state_change' END AS reason FROM ({LINES}) b"""
FACT_KEY = "kind || ':' || subject_id || ':' || CASE WHEN predicate IN ('location', 'currently_at') THEN 'current_location' ELSE predicate END || ':' || coalesce(perspective_id, '')"
AT = "'{}/' || chunk_id || '/' || id"


def _say(rule: str, table: str, where: str, alias: str = "") -> str:
    return f"SELECT '{rule}' AS rule, {AT.format(table)} AS path FROM {where}"


FACT_RULES = union([
    *(_say(f"fact_{c}", "facts", f"f WHERE trim({c}) = ''") for c in ("id", "subject_id", "predicate", "value", "statement")),
    _say("fact_kind", "facts", "f WHERE kind = 'mood'"),
    _say("fact_status", "facts", "f WHERE status <> 'source_fact'"),
    _say("fact_subject", "facts", "f WHERE kind = 'location' AND subject_id NOT IN ('a', 'b')"),
    _say("constraint_subject", "facts", "f WHERE kind = 'constraint' AND subject_id NOT IN ('a', 'b', '全书')"),
    _say("fact_perspective", "facts", "f WHERE perspective_id = 'zz'"),
    _say("fact_reason", "facts", "f WHERE CASE WHEN supersedes IS NULL THEN reason IS NOT NULL ELSE coalesce(reason, '') NOT IN ('state_change', 'correction', 'reveal') END"),
    _say("supersedes_missing", "facts", "f WHERE supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.chunk_id = f.chunk_id AND g.id = f.supersedes)"),
    "SELECT 'supersedes_order', 'facts/' || f.chunk_id || '/' || f.id FROM f JOIN f g ON g.chunk_id = f.chunk_id AND g.id = f.supersedes WHERE g.pos >= f.pos",
    "SELECT 'supersedes_key', 'facts/' || f.chunk_id || '/' || f.id FROM f JOIN f g ON g.chunk_id = f.chunk_id AND g.id = f.supersedes WHERE f.key <> g.key",
    "SELECT 'supersedes_twice', 'facts/' || chunk_id || '/' || supersedes FROM f WHERE supersedes IS NOT NULL GROUP BY chunk_id, supersedes HAVING count(*) > 1",
    "SELECT 'duplicate_id', 'facts/' || chunk_id || '/' || id FROM f GROUP BY chunk_id, id HAVING count(*) > 1",
])


@query(f"WITH f AS (SELECT *, {FACT_KEY} AS key FROM ({FACTS}) z) {FACT_RULES}")
def fact_reports(spark, sf_dir):
    """D-05, D-16 .. D-19, D-21, D-22, L-03, L-05 .. L-10, L-12."""
    f = derived(spark, sf_dir, FACTS)
    people = f.select("chunk_id").distinct().select("chunk_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("id"))
    return R.fact_rules(f, people).union(R.supersession_rules(f)).union(R.duplicate_ids("facts", f))


# Events and threads of a chunk.
EVENTS = f"SELECT 'k' || k AS chunk_id, CASE WHEN f = 1 AND n > 5 THEN 'e5' ELSE 'e' || n END AS id, CASE WHEN f = 2 THEN '' ELSE 'it rains' END AS summary, CASE WHEN f = 3 THEN n - 1 WHEN f = 4 THEN NULL ELSE n END AS ord, CASE WHEN f = 5 THEN 'a,ghost' WHEN f = 6 THEN 'x,y' ELSE 'a,b' END AS who FROM ({LINES}) b"
THREADS = f"SELECT 'k' || k AS chunk_id, 't' || n AS id, CASE WHEN f = 7 THEN ' ' ELSE 'a letter' END AS summary, CASE WHEN f = 8 THEN 'closed' WHEN f = 9 THEN NULL WHEN n % 2 = 0 THEN 'open' ELSE 'mentioned' END AS action FROM ({LINES}) b"
CLOSED = f"SELECT 'k' || k AS chunk_id, CASE WHEN f = 10 THEN 't1' WHEN f = 11 THEN 'old' WHEN f = 12 THEN 'new' ELSE 't' || n END AS id FROM ({LINES}) b WHERE f BETWEEN 10 AND 16"


@query(f"""WITH e AS ({EVENTS}), t AS ({THREADS}), c AS ({CLOSED}) {union([
    _say("event_summary", "events", "e WHERE summary = ''"),
    _say("event_order", "events", "e WHERE coalesce(ord, 0) < 1"),
    _say("event_character", "events", "e, (SELECT unnest(['a', 'b', 'ghost', 'x', 'y']) AS w) WHERE contains(',' || who || ',', ',' || w || ',') AND w NOT IN ('a', 'b')"),
    "SELECT 'duplicate_id', 'events/' || chunk_id || '/' || id FROM e GROUP BY chunk_id, id HAVING count(*) > 1",
    _say("thread_summary", "threads", "t WHERE trim(summary) = ''"),
    _say("thread_action", "threads", "t WHERE coalesce(action, '') NOT IN ('open', 'mentioned', 'resolved')"),
    _say("thread_unknown", "threads", "c WHERE id NOT IN ('old', 't1', 't2', 't3', 't4', 't5', 't6')"),
    _say("thread_not_open", "threads", "c WHERE id = 'old'"),
    "SELECT 'thread_twice', 'threads/' || chunk_id || '/' || id FROM c GROUP BY chunk_id, id HAVING count(*) > 1",
])}""")
def event_and_thread_reports(spark, sf_dir):
    """D-05, D-23 .. D-25, L-13, L-14."""
    e = derived(spark, sf_dir, EVENTS).withColumn("character_ids", F.split("who", ","))
    people = e.select("chunk_id").distinct().select("chunk_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("id"))
    known = spark.sql("SELECT explode(array('t1', 't2', 't3', 't4', 't5', 't6')) AS id, 'open' AS status UNION ALL SELECT 'old', 'resolved'")
    parts = [R.event_rules(e, people), R.duplicate_ids("events", e), R.thread_rules(derived(spark, sf_dir, THREADS)), R.thread_resolution_rules(derived(spark, sf_dir, CLOSED), known)]
    return reduce(DataFrame.union, parts)


# References: chapters k1 (1 to 4) and k2 (5 to 12) in a core of 1 to 10.
REFS = f"SELECT 'k' || k AS chunk_id, 'r' || n AS id, CASE WHEN f = 1 THEN 'k9' WHEN n < 5 THEN 'k1' ELSE 'k2' END AS chapter, CASE WHEN f = 2 THEN 'other' ELSE 'k' || k END AS ref_chunk, CASE WHEN f = 3 THEN n + 5 WHEN f = 4 THEN n + 3 ELSE n END AS start, CASE WHEN f = 3 THEN n + 5 WHEN f = 4 THEN n + 2 WHEN f = 5 THEN n + 2 ELSE n END AS stop, f = 6 AS bare FROM ({LINES}) b"


@query(f"""WITH r AS ({REFS}), i AS (SELECT * FROM r WHERE NOT bare) {union([
    _say("refs_missing", "facts", "r WHERE bare"),
    _say("ref_chunk", "facts", "i WHERE ref_chunk <> chunk_id"),
    _say("ref_core", "facts", "i WHERE start < 1 OR stop > 10 OR start > stop"),
    _say("ref_chapter", "facts", "i WHERE chapter = 'k9'"),
    _say("ref_chapter_range", "facts", "i WHERE chapter = 'k1' AND (start < 1 OR stop > 4) OR chapter = 'k2' AND (start < 5 OR stop > 12)"),
])}""")
def reference_reports(spark, sf_dir):
    """D-11 .. D-15, L-17."""
    r = derived(spark, sf_dir, REFS)
    one = F.struct(F.col("chapter").alias("chapter_id"), F.col("ref_chunk").alias("chunk_id"), "start", F.col("stop").alias("end"))
    r = r.select("chunk_id", "id", F.when(~F.col("bare"), F.array(one)).alias("refs"))
    chapter = lambda i, a, b: F.struct(F.lit(i).alias("id"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    chunks = r.select("chunk_id").distinct().select("chunk_id", F.lit(1).alias("start"), F.lit(10).alias("end"), F.array(chapter("k1", 1, 4), chapter("k2", 5, 12)).alias("chapters"))
    return R.bad_refs("facts", r, chunks)


# Boundary states of a chunk of paragraphs 1 to 10.
BOUNDARY = union([
    f"SELECT 'k' || k AS chunk_id, CASE WHEN f = 1 THEN 'middle' WHEN f = 2 THEN NULL WHEN n % 2 = 0 THEN 'entry' ELSE 'exit' END AS side, CASE WHEN f = 3 THEN 5 WHEN n % 2 = 0 THEN 1 ELSE 10 END AS as_of, CASE WHEN f = 4 THEN 'ghost' || n ELSE 'p' || n END AS id, 'character' AS entity_type, 'location' AS field, 'yard' AS value FROM ({LINES}) b",
    f"SELECT 'k' || k, 'exit', 10, CASE WHEN f = 5 THEN 'o' ELSE 'o' || n END, 'object', 'holderCharacterId', CASE WHEN f = 6 THEN 'ghost' WHEN f = 7 THEN '' ELSE 'p' || n END FROM ({LINES}) b",
])
OUTSIDE = f"SELECT 'k' || k AS chunk_id FROM ({LINES}) b WHERE f = 8"


@query(f"""WITH b AS ({BOUNDARY}), o AS ({OUTSIDE}), j AS (SELECT b.*, b.chunk_id NOT IN (SELECT chunk_id FROM o) AS there FROM b) {union([
    _say("boundary_side", "boundary", "j WHERE coalesce(side, '') NOT IN ('entry', 'exit')"),
    _say("boundary_chunk", "boundary", "j WHERE NOT there"),
    _say("boundary_anchor", "boundary", "j WHERE there AND (side = 'entry' AND as_of <> 1 OR side = 'exit' AND as_of <> 10)"),
    _say("boundary_character", "boundary", "j WHERE entity_type = 'character' AND id LIKE 'ghost%'"),
    _say("boundary_holder", "boundary", "j WHERE entity_type = 'object' AND value = 'ghost'"),
    "SELECT 'boundary_twice', 'boundary/' || chunk_id || '/' || id FROM j GROUP BY chunk_id, side, entity_type, id, field HAVING count(*) > 1",
])}""")
def boundary_reports(spark, sf_dir):
    """D-29 .. D-31, L-15, L-16."""
    b = derived(spark, sf_dir, BOUNDARY)
    ids = b.select("chunk_id").distinct()
    chunks = ids.join(derived(spark, sf_dir, OUTSIDE), "chunk_id", "left_anti").select("chunk_id", F.lit(1).alias("start"), F.lit(10).alias("end"))
    people = derived(spark, sf_dir, f"SELECT 'k' || k AS chunk_id, 'p' || n AS id FROM ({LINES}) b")
    return R.boundary_rules(b, chunks, people)


# Conflicts closed by facts: the existing fact is f1 of the order, the one that settles it f2.
SETTLED = f"SELECT 'k' || k AS chunk_id, 'x' || k || '_' || CASE WHEN f = 1 THEN 1 ELSE n END AS id, CASE WHEN f = 2 THEN 'guess' WHEN n % 3 = 0 THEN 'confirmed_existing' WHEN n % 3 = 1 THEN 'confirmed_incoming' ELSE 'state_change' END AS resolution, CASE WHEN f = 3 THEN ' ' ELSE 'it says so' END AS explanation, CASE WHEN f = 4 THEN NULL WHEN f = 5 THEN 'none' ELSE 'k' || k || '/f' || n END AS fact_id FROM ({LINES}) b"
CONFLICTS = f"SELECT 'x' || k || '_' || n AS id, CASE WHEN f = 6 THEN 'resolved' ELSE 'open' END AS status, 'k' || k || '/old' AS existing_id, CASE WHEN f = 7 THEN NULL ELSE 'New' END AS incoming_value FROM ({LINES}) b"
SIDES = union([
    f"SELECT 'k' || k || '/f' || n AS id, CASE WHEN f = 8 THEN 'j' ELSE 'key' END AS key, CASE WHEN f = 9 THEN 'else' WHEN n % 3 = 0 THEN 'o ld' ELSE 'new' END AS value, CASE WHEN f = 10 THEN NULL ELSE 'k' || k || '/old' END AS supersedes FROM ({LINES}) b",
    f"SELECT DISTINCT 'k' || k || '/old', 'key', 'Old', CAST(NULL AS STRING) FROM ({LINES}) b",
])


@query(f"""WITH c AS ({SETTLED}), o AS ({CONFLICTS}), f AS ({SIDES}),
j AS (SELECT c.*, o.status, CASE WHEN o.status = 'open' THEN o.incoming_value END AS incoming, CASE WHEN o.status = 'open' THEN g.key END AS old_key, g.value AS old_value, n.key AS new_key, n.value AS new_value, coalesce(n.supersedes = o.existing_id, false) AS after
  FROM c LEFT JOIN o ON o.id = c.id LEFT JOIN f g ON g.id = o.existing_id LEFT JOIN f n ON n.id = c.fact_id) {union([
    _say("conflict_not_open", "conflicts", "j WHERE coalesce(status, '') <> 'open'"),
    _say("conflict_explanation", "conflicts", "j WHERE trim(explanation) = ''"),
    _say("conflict_fact", "conflicts", "j WHERE fact_id IS NOT NULL AND new_key IS NULL"),
    "SELECT 'conflict_twice', 'conflicts/' || chunk_id || '/' || id FROM c GROUP BY chunk_id, id HAVING count(*) > 1",
    _say("conflict_resolution", "conflicts", "c WHERE resolution = 'guess'"),
    _say("conflict_fact_missing", "conflicts", "c WHERE fact_id IS NULL"),
    _say("conflict_unstructured", "conflicts", "j WHERE incoming IS NULL OR old_key IS NULL"),
    _say("conflict_fact_unrelated", "conflicts", "j WHERE incoming IS NOT NULL AND old_key IS NOT NULL AND new_key IS NOT NULL AND NOT (new_key = old_key AND CASE resolution WHEN 'confirmed_existing' THEN lower(replace(new_value, ' ', '')) = lower(old_value) WHEN 'confirmed_incoming' THEN lower(new_value) = lower(incoming) AND after WHEN 'state_change' THEN after ELSE true END)"),
])}""")
def conflict_reports(spark, sf_dir):
    """D-27, D-28: the rows are made once for all rules."""
    c, o, f = (derived(spark, sf_dir, v) for v in (SETTLED, CONFLICTS, SIDES))
    return R.conflict_report(c, o, staged(f))


# Ids with their chunk in front, and values that are both a character's and an object's id.
SCOPED = f"SELECT 'k' || k AS chunk_id, CASE WHEN f = 1 AND n > 3 THEN 'k' || k || '::i' || (n - 3) ELSE 'i' || n END AS id, CASE WHEN f = 2 THEN 'i' || n WHEN f = 3 THEN 'box' ELSE 'v' END AS value FROM ({LINES}) b"
THINGS = f"SELECT 'k' || k AS chunk_id, CASE WHEN f = 2 AND n % 2 = 0 THEN 'i' || n ELSE 'box' || n END AS id FROM ({LINES}) b"
FULL = "CASE WHEN id LIKE chunk_id || '::%' THEN id ELSE chunk_id || '::' || id END"


@query(f"""WITH s AS ({SCOPED}), t AS ({THINGS}) {union([
    *(f"SELECT 'scoped_twice' AS rule, '{x}/' || chunk_id || '/' || {FULL} AS path FROM s GROUP BY chunk_id, {FULL} HAVING count(*) > 1" for x in ("characters", "facts")),
    "SELECT 'value_ambiguous', 'facts/' || chunk_id || '/' || id FROM s WHERE EXISTS (SELECT 1 FROM s c WHERE c.chunk_id = s.chunk_id AND c.id = s.value) AND EXISTS (SELECT 1 FROM t WHERE t.chunk_id = s.chunk_id AND t.id = s.value)",
])}""")
def scoped_reports(spark, sf_dir):
    """L-18, L-19."""
    s, t = derived(spark, sf_dir, SCOPED), derived(spark, sf_dir, THINGS)
    return R.scoped_rules(s.select("chunk_id", "id"), s, t)


QUERIES, ORACLES = oracle(__name__)
