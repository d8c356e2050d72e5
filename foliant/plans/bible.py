"""Knowledge-base merges, snapshots, raw-shape rules and the screenplay loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import knowledge as K
from foliant.operators import repair as P
from foliant.operators import rules as R
from foliant.operators import screenplay as S
from foliant.plans.base import fixture, oracle, query, read, values

L = lambda c, a=None: (F.col(c) if isinstance(c, str) else c).cast("long").alias(a or c)


@query("""WITH a AS (SELECT user_id, (event_id // 500)::BIGINT AS seg, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'resolved' ELSE 'mentioned' END AS act FROM events),
t AS (SELECT user_id, seg, bool_or(act = 'open') AS opened, bool_or(act = 'resolved') AS resolved FROM a GROUP BY ALL), l AS (SELECT user_id, arg_max(opened, seg) AS opened, max(seg) AS seg FROM t WHERE opened OR resolved GROUP BY user_id)
SELECT a.user_id, min(a.seg) AS introduced, CASE WHEN any_value(l.opened) = false THEN 'resolved' ELSE 'open' END AS status, CASE WHEN any_value(l.opened) = false THEN any_value(l.seg) END AS resolved_at FROM a LEFT JOIN l ON a.user_id = l.user_id GROUP BY a.user_id""")
def thread_summaries(spark, sf_dir):
    """F-14: every thread, also one that is only mentioned."""
    e = read(spark, sf_dir, "events", "user_id", F.floor(F.col("event_id") / 500).alias("seg"), "event_type")
    act = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "resolved").otherwise("mentioned")
    return K.thread_summary(e.withColumn("act", act), ["user_id"], "seg", "act")


OLD, NEW = "('n', 'e1', 'arrives', 3, 1), ('n', 'e2', 'leaves', 9, 2)", "('n', 'e1', 'Arri ves', 8, 1), ('n', 'e3', 'rests', 3, 2), ('n', 'e2', 'stays', 1, 3), ('n', 'e3', 'sleeps', 1, 4)"


def timelines(spark):
    c = "novel_id, id, summary, first, ord"
    return K.merge_timeline(values(spark, OLD, c), values(spark, NEW, c))


@fixture(f"""WITH r AS (SELECT *, 0 AS p FROM (VALUES {OLD}) t(novel_id, id, summary, first, ord) UNION ALL SELECT *, 1 FROM (VALUES {NEW}) t(novel_id, id, summary, first, ord)), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, ord) AS k FROM r)
SELECT id, summary, row_number() OVER (ORDER BY first, p, ord)::BIGINT AS ord FROM k WHERE k = 1""")
def timeline_merge(spark, sf_dir):
    """F-08."""
    return timelines(spark)[0].select("id", "summary", L("ord"))


@fixture("SELECT * FROM (VALUES ('e2', 'timeline_differs'), ('e3', 'timeline_differs')) t(id, rule)")
def timeline_merge_conflicts(spark, sf_dir):
    """F-08."""
    return timelines(spark)[1].select("id", "rule")


ISLANDS = "('k', 1, 'f1', 'a', 's1', 'uncertain', 'r1'), ('k', 2, 'f2', 'A', 's2', 'source_fact', 'r2'), ('k', 3, 'f3', ' a', 's3', 'source_fact', 'r1'), ('k', 4, 'f4', 'b', 's4', 'uncertain', 'r3'), ('j', 1, 'f5', 'c', 's5', 'source_fact', 'r4')"


@fixture(f"""WITH f AS (SELECT *, replace(lower(value), ' ', '') AS v FROM (VALUES {ISLANDS}) t(key, ord, id, value, statement, status, ref)), h AS (SELECT *, CASE WHEN lag(v) OVER w IS DISTINCT FROM v THEN 1 ELSE 0 END AS head FROM f WINDOW w AS (PARTITION BY key ORDER BY ord)),
n AS (SELECT *, sum(head) OVER (PARTITION BY key ORDER BY ord) AS island FROM h)
SELECT key, island::BIGINT AS island, arg_min(id, ord) AS id, CASE WHEN arg_min(status, ord) = 'uncertain' AND bool_or(status = 'source_fact') THEN arg_min(statement, ord) FILTER (status = 'source_fact') ELSE arg_min(statement, ord) END AS statement,
  CASE WHEN bool_or(status = 'source_fact') THEN 'source_fact' ELSE 'uncertain' END AS status, count(DISTINCT ref)::BIGINT AS refs FROM n GROUP BY key, island""")
def island_facts(spark, sf_dir):
    """F-05: merged references, certainty and statement of an island."""
    f = values(spark, ISLANDS, "key, ord, id, value, statement, status, ref").withColumn("refs", F.array("ref"))
    got = K.island_facts(f, ["key"], ["ord"], K.norm_text(F.col("value")))
    return got.select("key", "island", "id", "statement", "status", L(F.size("refs"), "refs"))


SIDES = """('n', 0, 'c1', 'entry', 'scene', 'scene', 'location', 'Yard', NULL), ('n', 0, 'c1', 'exit', 'scene', 'scene', 'location', 'y ard', NULL), ('n', 1, 'c2', 'entry', 'scene', 'scene', 'location', 'street', NULL), ('n', 1, 'c2', 'exit', 'scene', 'scene', 'location', '', NULL),
('n', 0, 'c1', 'entry', 'character', 'lin', 'knowledge', NULL, ''), ('n', 0, 'c1', 'exit', 'character', 'lin', 'knowledge', NULL, 'key'), ('n', 1, 'c2', 'entry', 'character', 'lin', 'knowledge', NULL, 'key|key'), ('n', 1, 'c2', 'entry', 'character', 'wang', 'knowledge', NULL, 'x'), ('n', 0, 'c1', 'exit', 'object', 'key', 'holderCharacterId', 'lin', NULL), ('n', 1, 'c2', 'entry', 'object', 'key', 'holderCharacterId', 'wang', NULL)"""


@fixture("""SELECT * FROM (VALUES ('boundary:c1:c2:scene:scene:location', 'y ard', 'street'), ('boundary:c1:c1:character:lin:knowledge', '[]', '["key"]'), ('boundary:c1:c2:object:key:holderCharacterId', 'lin', 'wang')) t(issue_id, left_value, right_value)""")
def boundary_issues(spark, sf_dir):
    """F-15, J-10, K-04, T9: an empty set differs from a set, an empty text from
    nothing; a repeated entry doesn't matter; an unmatched entity is passed over."""
    s = values(spark, SIDES, "novel_id, idx, chunk_id, side, entity_type, entity_id, field, value, list")
    s = s.withColumn("items", F.when(F.col("list").isNotNull(), F.filter(F.split("list", "[|]"), lambda x: x != "")))
    return K.boundary_issues(s).select("issue_id", "left_value", "right_value")


@fixture("SELECT * FROM (VALUES ('f1', 'f2', ''), ('f2', 'f3', 'f1'), ('f3', '', 'f2'), ('g1', '', '')) t(id, superseded_by, supersedes)")
def state_changes(spark, sf_dir):
    """F-19: a chain of changes in issue order; a change whose existing fact isn't
    in force, or of another key, does nothing."""
    f = values(spark, "('n', 'f1', 'loc', 'a', NULL), ('n', 'g1', 'own', 'x', NULL)", "novel_id, id, key, value, superseded_by").withColumn("superseded_by", F.col("superseded_by").cast("string"))
    c = values(spark, "('n', 'x1', 'f1', 'f2', 'loc', 'b'), ('n', 'x2', 'f2', 'f3', 'loc', 'c'), ('n', 'x3', 'f1', 'f9', 'loc', 'd'), ('n', 'x4', 'g1', 'g2', 'loc', 'y')", "novel_id, conflict_id, existing_id, incoming_id, key, value")
    t = values(spark, "('n', 1, 'f1', 'f2'), ('n', 2, 'f2', 'f3'), ('n', 3, 'f1', 'f9'), ('n', 4, 'g1', 'g2')", "novel_id, ord, existing_id, incoming_id")
    return P.apply_state_changes(f, c, t)[0].select("id", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"), F.coalesce("supersedes", F.lit("")).alias("supersedes"))


DECIDED, ISSUES = "('i1', 'unresolved'), ('i2', 'continuous'), ('i3', 'unresolved'), ('i4', 'unresolved')", "('n', 2, 'i1'), ('n', 1, 'i3'), ('n', 3, 'i2'), ('m', 1, 'i4')"


@fixture(f"""SELECT novel_id, issue_id, 'conflict_boundary_' || lpad((row_number() OVER (PARTITION BY novel_id ORDER BY ord))::VARCHAR, 3, '0') AS conflict_id
FROM (VALUES {ISSUES}) t(novel_id, ord, issue_id) JOIN (VALUES {DECIDED}) d(id, decision) ON id = issue_id WHERE decision = 'unresolved'""")
def residual_conflicts(spark, sf_dir):
    """F-20: numbered within each novel."""
    return P.residual_conflicts(values(spark, DECIDED, "issue_id, decision"), values(spark, ISSUES, "novel_id, ord, issue_id")).select("novel_id", "issue_id", "conflict_id")


@fixture("SELECT * FROM (VALUES ('n', 1::BIGINT, 'identity', 'a'), ('n', 2, 'fact', 'b'), ('n', 3, 'fact', 'c'), ('n', 4, 'boundary', 'd'), ('m', 1, 'fact', 'e')) t(novel_id, ord, kind, conflict_id)")
def conflict_order(spark, sf_dir):
    """F-21."""
    part = lambda rows: values(spark, rows, "novel_id, conflict_id")
    return P.conflict_list({"boundary": part("('n', 'd')"), "fact": part("('n', 'c'), ('n', 'b'), ('m', 'e')"), "identity": part("('n', 'a')")}).select("novel_id", L("ord"), "kind", "conflict_id")


def bible(spark):
    c = values(spark, "('n', 1, 'lin', '苏禾', array('小 禾'), 'tall', NULL), ('n', 2, 'wang', '老贺', array(), '', 'provisional'), ('n', 3, 'zhao', '赵', array(), '', NULL), ('n', 4, 'wu', '吴', array(), '', NULL)", "novel_id, ord, id, name, aliases, description, identity_status")
    f = values(spark, "('n', 1, 'f1', 'relationship', 'lin', 'knows', 'wang', 'source_fact', NULL, NULL), ('n', 2, 'f2', 'location', 'lin', 'p', 'x', 'source_fact', NULL, 'f1'), ('n', 3, 'f3', 'constraint', 'story', 'p', 'x', 'source_fact', NULL, NULL), ('n', 4, 'f4', 'location', 'wang', 'p', 'y', 'source_fact', NULL, NULL), ('n', 5, 'f5', 'location', 'zhao', 'p', 'y', 'source_fact', NULL, NULL), ('n', 6, 'f6', 'relationship', 'wang', 'knows', 'wu', 'source_fact', NULL, NULL), ('n', 7, 'f7', 'knowledge', 'zhao', 'p', 'z', 'uncertain', 'wu', NULL)", "novel_id, ord, id, kind, subject_id, predicate, value, status, perspective_id, superseded_by")
    t = spark.range(1, 51).select(F.lit("n").alias("novel_id"), F.col("id").cast("int").alias("ord"), F.format_string("e%02d", "id").alias("id"), F.lit("s").alias("summary"), F.array().cast("array<string>").alias("character_ids"))
    h = values(spark, "('n', 1, 't1', 'x', 'open'), ('n', 2, 't2', 'y', 'resolved'), ('n', 3, 't3', repeat('z', 200), 'open'), ('n', 4, 't4', 'w', 'open')", "novel_id, ord, id, summary, status")
    x = values(spark, "('n', 1, 'k1', 'd', 'open')", "novel_id, ord, id, description, status")
    b = values(spark, "('n', 'c2', 'zhao')", "novel_id, chunk_id, id")
    return c, f, t, h, x, b, values(spark, "('n', 'c1', '小禾来了'), ('n', 'c2', '无人')", "novel_id, chunk_id, text")


@fixture("SELECT * FROM (VALUES ('c1', 'f1'), ('c1', 'f3'), ('c1', 'f4'), ('c1', 'f6'), ('c1', 'f7'), ('c2', 'f3'), ('c2', 'f5'), ('c2', 'f7')) t(chunk_id, id)")
def relevance_snapshot(spark, sf_dir):
    """P-05, P-06: a character of the boundary state counts as named, and the
    values of facts carry on in their order: lin, wang, wu."""
    c, f, _, _, _, b, text = bible(spark)
    return P.relevant_facts(f, P.mentioned(c, b, f, text), text).select("chunk_id", "id")


SMALL = {"characterIndex": 200, "relevantCharacters": 10_000, "activeFactIndex": 11_000, "relevantFacts": 24_000, "timelineIndex": 7_000, "recentTimeline": 10_000, "openThreads": 150, "openConflicts": 16_000}


@fixture("""SELECT * FROM (VALUES ('c1', 'characterIndex', 'lin,wang', 2::BIGINT), ('c1', 'relevantCharacters', 'lin,wang,wu', 0), ('c1', 'activeFactIndex', 'f7,f6,f4,f3,f1,f5', 0), ('c1', 'relevantFacts', 'f7,f6,f4,f3,f1,f5', 0), ('c1', 'openThreads', 't4,t1', 1), ('c1', 'openConflicts', 'k1', 0),
('c2', 'characterIndex', 'zhao,wu', 2), ('c2', 'relevantCharacters', 'zhao', 0), ('c2', 'activeFactIndex', 'f7,f5,f3,f6,f4,f1', 0), ('c2', 'relevantFacts', 'f7,f5,f3,f6,f4,f1', 0), ('c2', 'openThreads', 't4,t1', 1), ('c2', 'openConflicts', 'k1', 0)) t(chunk_id, section, ids, omitted)""")
def snapshot_sections(spark, sf_dir):
    """F-22, O-03 .. O-05, P-07, U-02: what matters first, then from the last; an
    item that doesn't fit is passed over."""
    shown = P.snapshot(*bible(spark), SMALL).where("section not in ('timelineIndex', 'recentTimeline')")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("taken"), F.struct("pos", "id")))), lambda v: v["id"]), ",")
    return shown.groupBy("chunk_id", "section").agg(ids.alias("ids"), F.count_if(~F.col("taken")).alias("omitted"))


@fixture("SELECT chunk_id, section, n AS taken, 0::BIGINT AS omitted FROM (VALUES ('c1'), ('c2')) c(chunk_id), (VALUES ('timelineIndex', 50::BIGINT), ('recentTimeline', 40)) s(section, n)")
def snapshot_counts(spark, sf_dir):
    """F-22: of the events the last 40 in full, all in the index."""
    return P.snapshot_counts(P.snapshot(*bible(spark))).where("section in ('timelineIndex', 'recentTimeline')").select("chunk_id", "section", "taken", "omitted")


DELTA = """('c1', '{"chunkId":"c1","processedRange":{"start":1,"end":10},"characters":[{"id":"lin","name":"苏禾","aliases":[]},{"id":"wang","name":"王五","aliases":["a",1],"description":5,"identityStatus":"confirmed"},{"id":"x","name":" ","aliases":[]}],"newFacts":[{"id":"f","supersededByFactId":"g"}],"timelineEvents":[],"openedThreads":[],"resolvedThreads":[],"reportedConflicts":[{"description":""}],"resolvedConflicts":[],"boundaryState":{"characters":[],"objects":[],"openReferences":[{"text":"","candidateCharacterIds":["lin","ghost"]},{"text":"他","candidateCharacterIds":"x"}],"timeLabel":3,"location":"yard"}}'),
('c2', '{"chunkId":"c9","processedRange":{"start":11,"end":19},"characters":[],"newFacts":{},"timelineEvents":[],"openedThreads":[],"resolvedThreads":[],"reportedConflicts":[],"resolvedConflicts":[]}'), ('c3', '[1]'), ('c4', 'no json')"""


def spans(spark) -> DataFrame:
    return values(spark, "('c1', 1, 10, 0), ('c2', 11, 20, 9), ('c3', 21, 30, 20), ('c4', 31, 40, 30)", "chunk_id, start, end, done")


@fixture("""SELECT * FROM (VALUES ('character_name', 'raw/c1/characters[2].name'), ('character_aliases', 'raw/c1/characters[1].aliases'), ('character_description', 'raw/c1/characters[1].description'), ('character_renamed', 'raw/c1/characters[1].name'), ('server_field', 'raw/c1/characters[1].identityStatus'), ('server_field', 'raw/c1/newFacts[0].supersededByFactId'),
('conflict_description', 'raw/c1/reportedConflicts[0].description'), ('boundary_label', 'raw/c1/boundaryState.timeLabel'), ('reference_text', 'raw/c1/boundaryState.openReferences[0].text'), ('reference_candidates', 'raw/c1/boundaryState.openReferences[1].candidateCharacterIds'), ('reference_unknown', 'raw/c1/boundaryState.openReferences[0].candidateCharacterIds'),
('chunk_id', 'raw/c2/chunkId'), ('range', 'raw/c2/processedRange'), ('continuity', 'raw/c2/processedRange'), ('list_missing', 'raw/c2/newFacts'), ('boundary_missing', 'raw/c2/boundaryState'), ('root', 'raw/c3/'), ('invalid_json', 'raw/c4/')) t(rule, path)""")
def delta_shapes(spark, sf_dir):
    """D-01 .. D-04, D-06 .. D-10, D-20, D-26, D-29, D-32, D-33, D-35."""
    return R.delta_shapes(values(spark, DELTA, "chunk_id, raw"), spans(spark), values(spark, "('lin', '苏 禾'), ('wang', '老贺')", "id, name"))


@fixture("SELECT 'too_long' AS rule, 'raw/c1/' AS path UNION ALL SELECT 'boundary_size', 'raw/c1/boundaryState'")
def delta_sizes(spark, sf_dir):
    """D-29, D-34."""
    lists = ",".join(f'"{k}":[]' for k in R.DELTA_LISTS)
    raw = f"""('c1', concat('{{"chunkId":"c1","processedRange":{{"start":1,"end":10}},{lists},"boundaryState":{{"characters":[],"objects":[],"openReferences":[],"location":"', repeat('x', 200000), '"}}}}'))"""
    return R.delta_shapes(values(spark, raw, "chunk_id, raw"), spans(spark), values(spark, "('lin', '苏 禾')", "id, name"))


@fixture("""SELECT * FROM (VALUES ('range', 'raw/c1/coreRange'), ('list_missing', 'raw/c1/facts'), ('character_name', 'raw/c1/characters[0].name'), ('server_field', 'raw/c2/facts[0].supersededByFactId'), ('scoped_twice', 'characters/c1/c1::a'), ('value_ambiguous', 'facts/c1/f1')) t(rule, path)""")
def local_shapes(spark, sf_dir):
    """L-01, L-02, L-04, L-11, L-18, L-19."""
    raw = """('c1', '{"chunkId":"c1","coreRange":{"start":1,"end":9},"characters":[{"id":"a","aliases":[]}],"timelineEvents":[],"threadObservations":[]}'), ('c2', '{"chunkId":"c2","coreRange":{"start":11,"end":20},"characters":[],"facts":[{"supersededByFactId":null}],"timelineEvents":[],"threadObservations":[]}')"""
    shapes = R.local_shapes(values(spark, raw, "chunk_id, raw"), spans(spark))
    facts = values(spark, "('c1', 'f1', 'key'), ('c1', 'f2', 'a')", "chunk_id, id, value")
    return shapes.union(R.scoped_rules(values(spark, "('c1', 'a'), ('c1', 'c1::a'), ('c1', 'key')", "chunk_id, id"), facts, values(spark, "('c1', 'key')", "chunk_id, id")))


@fixture("""SELECT * FROM (VALUES ('conflict_resolution', 'conflicts/c1/x5'), ('conflict_fact_missing', 'conflicts/c1/x5'), ('conflict_unstructured', 'conflicts/c1/x4'), ('conflict_fact_unrelated', 'conflicts/c1/x2'), ('conflict_fact_unrelated', 'conflicts/c1/x3')) t(rule, path)""")
def closing_rules(spark, sf_dir):
    """D-27, D-28: x1 is closed rightly, x2 by a fact of another key, x3 by one
    that doesn't supersede, x4 has one side, x5 has no fact."""
    closed = values(spark, "('c1', 'x1', 'confirmed_incoming', 'f2'), ('c1', 'x2', 'state_change', 'g1'), ('c1', 'x3', 'correction', 'f3'), ('c1', 'x4', 'correction', 'f2'), ('c1', 'x5', 'guess', '')", "chunk_id, id, resolution, fact_id")
    conflicts = values(spark, "('x1', 'open', 'f1', 'B'), ('x2', 'open', 'f1', 'b'), ('x3', 'open', 'f1', 'b'), ('x4', 'open', 'f1', NULL), ('x5', 'open', 'f1', 'b')", "id, status, existing_id, incoming_value")
    facts = values(spark, "('f1', 'k', 'a', NULL), ('f2', 'k', 'b', 'f1'), ('f3', 'k', 'c', NULL), ('g1', 'j', 'b', 'f1')", "id, key, value, supersedes")
    return R.closing_rules(closed, conflicts, facts)


@fixture("SELECT * FROM (VALUES ('constraint', '全 书', 'global:story'), ('constraint', 'lin', 'lin'), ('location', 'story', 'story')) t(kind, subject, canonical)")
def global_subjects(spark, sf_dir):
    """P-11."""
    return values(spark, "('constraint', '全 书'), ('constraint', 'lin'), ('location', 'story')", "kind, subject").select("kind", "subject", R.global_subject(F.col("kind"), F.col("subject")).alias("canonical"))


@fixture("""SELECT * FROM (VALUES ('a', 'root', '(root)'), ('b', 'character', 'characters[1]'), ('b', 'scene', 'scenes[0]'), ('b', 'heading', 'scenes[1].heading'), ('b', 'elements', 'scenes[1].elements'), ('b', 'element', 'scenes[2].elements[0]'), ('b', 'heading', 'scenes[2].heading'), ('c', 'root', '(root)')) t(project, rule, path)""")
def screenplay_shapes(spark, sf_dir):
    """Q-01, Q-04, Q-09, Q-12, Q-16, Q-18."""
    raw = """('a', '[]'), ('b', '{"characters":[{"id":"x"},"y"],"scenes":[5,{"id":"s"},{"heading":[],"elements":["e",{"type":"action"}]}]}'), ('c', 'oops'), ('d', '{}')"""
    return S.shape_violations(values(spark, raw, "project, json"))


@fixture("""SELECT * FROM (VALUES ('p', 'character_id', 'characters[2].id'), ('p', 'character_name', 'characters[2].name'), ('p', 'character_duplicate', 'characters[1].id'), ('p', 'scene_id', 'scenes[1].id'), ('p', 'type', 'scenes[1].elements[0].type'), ('p', 'lines', 'scenes[1].elements[1].lines'), ('p', 'speaker', 'scenes[1].elements[2].lines[1].character'), ('p', 'line', 'scenes[1].elements[2].lines[1].line'), ('p', 'speaker_unknown', 'scenes[1].elements[2].lines[0].character'),
('q', 'characters', 'characters'), ('q', 'scenes', 'scenes')) t(project, rule, path)""")
def screenplay_violations_more(spark, sf_dir):
    """Q-03, Q-05 .. Q-08, Q-10, Q-19, Q-21, Q-22, Q-24, by project."""
    c = values(spark, "('p', 0, 'a', 'A', array()), ('p', 1, 'a', 'B', array()), ('p', 2, '', ' ', array())", "project, ord, id, name, aliases")
    s = values(spark, "('p', 1, '', 1, 'INT', 'x', 'DAY', true)", "project, scene, id, number, setting, location, time, has_source")
    e = values(spark, "('p', 1, 0, NULL, 'song', NULL, NULL, NULL, NULL), ('p', 1, 1, NULL, 'dual_dialogue', NULL, NULL, NULL, NULL), ('p', 1, 2, 0, 'dual_dialogue', NULL, 'ghost', 'x', NULL), ('p', 1, 2, 1, 'dual_dialogue', NULL, '', '', NULL)", "project, scene, pos, line_pos, type, text, character, line, mode")
    e = e.select("project", "scene", "pos", "line_pos", "type", *(F.col(x).cast("string").alias(x) for x in ("text", "character", "line", "mode")))
    got = S.violations(values(spark, "('p', 'T'), ('q', 'U')", "project, title"), c, s, e, values(spark, "('p', 0, '')", "project, pos, scene_id"))
    return got.where("severity = 'error'").select("project", "rule", "path")


@fixture("SELECT * FROM (VALUES ('a', 'c', 0::BIGINT), ('a', 'x', 1), ('a', 'y', 1), ('b', 'x', 0)) t(project, id, degree)")
def relation_nodes(spark, sf_dir):
    """G-06, I-04: characters without an edge are nodes too, and projects apart."""
    c = values(spark, "('a', 0, 'x', '苏禾', array()), ('a', 1, 'y', '老贺', array()), ('a', 2, 'c', '赵', array()), ('b', 0, 'x', '苏禾', array())", "project, ord, id, name, aliases")
    e = values(spark, "('a', 1, 0, 'action', '苏禾见老贺', NULL), ('b', 1, 0, 'action', '苏禾见老贺', NULL)", "project, scene, pos, type, text, character")
    return S.relation_nodes(e.withColumn("character", F.col("character").cast("string")), c)


@fixture("SELECT * FROM (VALUES ('a', 0::BIGINT, 3::BIGINT, false, 3::BIGINT), ('b', 0, 1, true, 1), ('c', 1, 1, true, 1), ('d', 1, 0, true, 0)) t(project, errors, warnings, repaired, scenes)")
def repair_loop(spark, sf_dir):
    """G-04, G-05: a is fine, b is repaired, c's repair can't be read, d has no
    scene; what is left over comes back with its errors."""
    scene = lambda place: f'{{"id":"z","heading":{{"setting":"INT","location":"{place}","time":"DAY"}},"elements":[{{"type":"transition","text":"cut"}}]}}'
    good, bad = scene("yard"), scene("")
    b = values(spark, f"""('a', 0, '{{"scenes":[{good},{good}]}}'), ('a', 1, '{{"scenes":[{good}]}}'), ('b', 0, '{{"scenes":[{bad}]}}'), ('c', 0, '{{"scenes":[{bad}]}}'), ('d', 0, 'none')""", "project, ord, json")
    p = values(spark, "('a', 'T'), ('b', 'T'), ('c', 'T'), ('d', 'T')", "project, title")
    c = p.select("project", F.lit(0).alias("ord"), F.lit("x").alias("id"), F.lit("X").alias("name"), F.array().cast("array<string>").alias("aliases"))
    new = values(spark, f"""('b', '{{"scenes":[{good}]}}'), ('c', 'sorry')""", "project, json")
    return S.generate(p, c, b, lambda errors: errors.select("project").distinct().join(new, "project", "left")) ["status"].select("project", "errors", "warnings", "repaired", L("scenes"))


@query("SELECT conv_id, role, n, least(n, 5)::BIGINT AS first, greatest(n - 5, 0)::BIGINT AS more FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)")
def issue_summary(spark, sf_dir):
    """A-16: how many, the first five, and how many more."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project"), F.col("role").alias("severity"), F.col("turn").cast("string").alias("path"), F.lit("x").alias("rule"))
    return S.report_lines(c).select(F.col("project").alias("conv_id"), F.col("severity").alias("role"), "n", L(F.size("first"), "first"), L("more"))


@query("SELECT o_orderkey AS scene, l_linenumber AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 2 AND 3")
def scene_paragraphs(spark, sf_dir):
    """I-02, J-05: the lines of a range."""
    s = read(spark, sf_dir, "orders", F.col("o_orderkey").alias("project"), F.col("o_orderkey").alias("scene"), F.lit(2).alias("first"), F.lit(3).alias("last"))
    return S.scene_of_paragraph(s, read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("project"), F.col("l_linenumber").alias("n"))).select("scene", "n")


QUERIES, ORACLES = oracle(__name__)
