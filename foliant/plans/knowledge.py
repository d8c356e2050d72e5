"""Rule reports and repair on inline fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import repair as P
from foliant.operators import rules as R
from foliant.operators.paging import budget_take
from foliant.plans.base import fixture, oracle, query, values

CHUNKS = "('c1', 1, 10, array(named_struct('id', 'k1', 'start', 1, 'end', 4), named_struct('id', 'k2', 'start', 5, 'end', 12)))"
CAST = "('c1', 'a'), ('c1', 'b')"
FACTS = """('c1', 'f1', 0, 'location', 'a', 'location', 'street', 's', 'source_fact', NULL, NULL, NULL), ('c1', 'f2', 1, 'location', 'a', 'currently_at', 'yard', 's', 'source_fact', NULL, 'f1', 'state_change'),
('c1', 'f3', 2, 'mood', 'a', 'p', ' ', 's', 'sure', 'zz', NULL, 'reveal'), ('c1', 'f4', 3, 'knowledge', 'ghost', 'p', 'v', 's', 'uncertain', NULL, 'f9', 'reveal'), ('c1', 'f5', 4, 'object', 'o', 'p', 'v', 's', 'source_fact', NULL, 'f6', 'correction'), ('c1', 'f6', 5, 'object', 'o', 'q', 'v', 's', 'source_fact', NULL, NULL, NULL),
('c1', 'f7', 6, 'constraint', '全书', 'p', 'v', 's', 'source_fact', NULL, NULL, NULL)"""


def facts(spark) -> DataFrame:
    return values(spark, FACTS, "chunk_id, id, pos, kind, subject_id, predicate, value, statement, status, perspective_id, supersedes, reason")


def cast(spark) -> DataFrame:
    return values(spark, CAST, "chunk_id, id")


def chunks(spark) -> DataFrame:
    return values(spark, CHUNKS, "chunk_id, start, end, chapters")


@fixture("""SELECT * FROM (VALUES ('fact_value', 'facts/c1/f3'), ('fact_kind', 'facts/c1/f3'), ('fact_status', 'facts/c1/f3'), ('fact_perspective', 'facts/c1/f3'), ('fact_reason', 'facts/c1/f3'), ('fact_subject', 'facts/c1/f4'),
('supersedes_missing', 'facts/c1/f4'), ('supersedes_order', 'facts/c1/f5'), ('supersedes_key', 'facts/c1/f5'), ('event_summary', 'events/c1/e1'), ('event_order', 'events/c1/e1'), ('event_character', 'events/c1/e2'), ('duplicate_id', 'events/c1/e2'), ('thread_action', 'threads/c1/t1'),
('ref_core', 'facts/c1/r2'), ('ref_chapter', 'facts/c1/r3'), ('ref_chapter_range', 'facts/c1/r4'), ('ref_chunk', 'facts/c1/r5'), ('refs_missing', 'facts/c1/r6')) t(rule, path)""")
def local_violations(spark, sf_dir):
    events = values(spark, "('c1', 'e1', '', 0, array('a')), ('c1', 'e2', 's', 1, array('a', 'ghost')), ('c1', 'e2', 's', 2, array('b'))", "chunk_id, id, summary, ord, character_ids")
    threads = values(spark, "('c1', 't1', 's', 'closed'), ('c1', 't2', 's', 'open')", "chunk_id, id, summary, action")
    ref = lambda chapter, chunk, a, b: f"array(named_struct('chapter_id', '{chapter}', 'chunk_id', '{chunk}', 'start', {a}, 'end', {b}))"
    refs = values(spark, f"('c1', 'r1', {ref('k1', 'c1', 1, 3)}), ('c1', 'r2', {ref('k2', 'c1', 9, 12)}), ('c1', 'r3', {ref('k9', 'c1', 2, 2)}), ('c1', 'r4', {ref('k1', 'c1', 4, 6)}), ('c1', 'r5', {ref('k1', 'c2', 1, 1)}), ('c1', 'r6', NULL)", "chunk_id, id, refs")
    parts = [R.fact_rules(facts(spark), cast(spark)), R.supersession_rules(facts(spark)), R.event_rules(events, cast(spark)), R.duplicate_ids("events", events), R.thread_rules(threads), R.bad_refs("facts", refs, chunks(spark))]
    return reduce(DataFrame.union, parts)


@fixture("""SELECT * FROM (VALUES ('thread_unknown', 'threads/c1/t9'), ('thread_not_open', 'threads/c1/t2'), ('thread_twice', 'threads/c1/t1'), ('boundary_side', 'boundary/c1/a'), ('boundary_anchor', 'boundary/c1/b'), ('boundary_character', 'boundary/c1/z'), ('boundary_holder', 'boundary/c1/o'),
('conflict_not_open', 'conflicts/c1/x2'), ('conflict_explanation', 'conflicts/c1/x2'), ('conflict_fact', 'conflicts/c1/x1')) t(rule, path)""")
def delta_violations(spark, sf_dir):
    resolved = values(spark, "('c1', 't1'), ('c1', 't1'), ('c1', 't2'), ('c1', 't9')", "chunk_id, id")
    boundary = values(spark, "('c1', 'middle', 1, 'a', 'character', 'location', 'x'), ('c1', 'entry', 3, 'b', 'character', 'location', 'x'), ('c1', 'exit', 10, 'z', 'character', 'location', 'x'), ('c1', 'exit', 10, 'o', 'object', 'holderCharacterId', 'ghost')", "chunk_id, side, as_of, id, entity_type, field, value")
    closed = values(spark, "('c1', 'x1', 'correction', 'why', 'f99'), ('c1', 'x2', 'correction', ' ', 'f1')", "chunk_id, id, resolution, explanation, fact_id")
    parts = [
        R.thread_resolution_rules(resolved, values(spark, "('t1', 'open'), ('t2', 'resolved')", "id, status")),
        R.boundary_rules(boundary, chunks(spark), cast(spark)),
        R.conflict_rules(closed, values(spark, "('x1', 'open'), ('x2', 'resolved')", "id, status"), facts(spark)),
    ]
    return reduce(DataFrame.union, parts).distinct()


ISSUES = """('i1', 'character', 'a', 'location', 'street', 'yard'), ('i2', 'character', 'a', 'knowledge', '["key"]', '["key","the door"]'), ('i3', 'character', 'b', 'activeGoals', '["flee"]', '["stay"]'), ('i4', 'object', 'o', 'state', 'whole', 'broken')"""


def issues(spark) -> DataFrame:
    return values(spark, ISSUES, "issue_id, entity_type, entity_id, field, exit, entry")


def told(spark) -> DataFrame:
    return values(spark, "('f1', 'location', 'a', 'location', 'Street', 's', NULL), ('f2', 'location', 'a', 'currently_at', 'yard', 's', NULL), ('k1', 'knowledge', 'a', 'knows', 'x', 's', NULL), ('k2', 'knowledge', 'a', 'knows', 'of the door', 's', NULL), ('g1', 'character', 'b', 'goal', 'flee', 's', NULL), ('g2', 'character', 'b', 'goal', 'stay', 's', NULL), ('o1', 'object', 'o', 'state', 'whole', 's', NULL)", "id, kind, subject_id, predicate, value, statement, perspective_id")


@fixture("SELECT * FROM (VALUES ('i1', 'f1', 'f2'), ('i2', 'k1', 'k2'), ('i2', 'k2', 'k1'), ('i3', 'g1', 'g2')) t(issue_id, existing_id, incoming_id)")
def allowed_transitions(spark, sf_dir):
    return P.allowed_transitions(issues(spark), told(spark))


@fixture("SELECT * FROM (VALUES ('i1', 'state_change', 'f1', 'f2'), ('i2', 'unresolved', '', ''), ('i3', 'unresolved', '', ''), ('i4', 'unresolved', '', '')) t(issue_id, decision, existing_id, incoming_id)")
def repair_decisions(spark, sf_dir):
    answers = values(spark, "('i1', 'state_change', 'f1', 'f2', 1), ('i2', 'state_change', 'k1', 'k2', 0), ('i3', 'state_change', 'g2', 'g1', 2)", "issue_id, decision, existing_id, incoming_id, n_refs")
    got = P.apply_answers(issues(spark), answers, P.allowed_transitions(issues(spark), told(spark)))
    return got.select("issue_id", "decision", *(F.coalesce(c, F.lit("")).alias(c) for c in ("existing_id", "incoming_id")))


@fixture("SELECT * FROM (VALUES (1::BIGINT, true, 'B'), (2, true, 'C'), (3, false, 'C')) t(ord, closed, active)")
def state_transitions(spark, sf_dir):
    t = values(spark, "('k', 1L, 'x1', 'A', 'B'), ('k', 2L, 'x2', 'B', 'C'), ('k', 3L, 'x3', 'A', 'D')", "key, ord, conflict_id, from_value, to_value")
    return P.apply_transitions(values(spark, "('k', 'A')", "key, active"), t).select("ord", "closed", "active")


@fixture("SELECT batch::BIGINT AS batch, count(*)::BIGINT AS n FROM (SELECT (i // 40) AS batch FROM range(45) t(i)) GROUP BY batch")
def repair_batches(spark, sf_dir):
    rows = spark.range(45).select(F.lit("c1/c2").alias("chunk_pair"), F.format_string("i%03d", "id").alias("issue_id"), F.lit(100).alias("size"))
    return P.repair_batches(rows).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))


@fixture("SELECT * FROM (VALUES ('a', 2::BIGINT, 1::BIGINT, 10::BIGINT)) t(k, taken, omitted, used)")
def budget_skip(spark, sf_dir):
    """An item that doesn't fit is passed over, a later one still taken."""
    return budget_take(values(spark, "('a', 1, 6), ('a', 2, 7), ('a', 3, 4)", "k, i, s"), "k", "i", "s", 10)


QUERIES, ORACLES = oracle(__name__)
