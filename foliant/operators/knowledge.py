"""Knowledge-base reductions (F-01 .. F-24) as windows over explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import norm_text


def fact_islands(facts: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """W-06: ``facts`` with island (from 1) and head: an island is a run of
    equal values of one key; its head is its first row."""
    w = W.partitionBy(*key).orderBy(*order)
    new = F.coalesce(~F.lag("_v").over(w).eqNullSafe(F.col("_v")), F.lit(True)) | (F.row_number().over(w) == 1)
    rows = facts.withColumn("_v", value).withColumn("head", new)
    return rows.withColumn("island", F.sum(F.col("head").cast("long")).over(w)).drop("_v")


def reduce_facts(facts: DataFrame, key: list[str], order: list[str], value: Column, supersedes: Column) -> DataFrame:
    """F-05, W-07: one row an island: head_id of its first fact, refs (facts
    merged into it) and accepted: the first island of a key is; a later one is if
    its head supersedes the island before it and that chain is unbroken.

    ``supersedes`` is the id of the fact that a fact replaces; it may name any
    fact of the island before.
    """
    rows = fact_islands(facts, key, order, value).withColumn("_s", supersedes)
    by = rows.groupBy(*key, "island").agg(F.min_by(F.struct("id", "_s"), F.struct(*order)).alias("h"), F.count("*").alias("refs"))
    by = by.select(*key, "island", F.col("h.id").alias("head_id"), F.col("h._s").alias("_s"), "refs")
    there = rows.select(*key, F.col("id").alias("_s"), F.col("island").alias("_t"))
    by = by.join(there, [*key, "_s"], "left")
    link = (F.col("island") == 1) | F.coalesce(F.col("_t") == F.col("island") - 1, F.lit(False))
    w = W.partitionBy(*key).orderBy("island")
    return by.withColumn("accepted", F.min(link.cast("int")).over(w) == 1).drop("_t", "_s")


def conflicts(reduced: DataFrame) -> DataFrame:
    """Islands that were not accepted."""
    return reduced.where("not accepted")


def island_facts(facts: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """F-05: (key, island, id, statement, status, refs): an island as one fact.
    Its id is its head's; it is certain as soon as one of its facts is, and the
    first certain one then speaks for it; refs are all references, each once.
    facts have id, statement, status and refs array besides."""
    rows = fact_islands(facts, key, order, value)
    sure = F.col("status") == "source_fact"
    by = rows.groupBy(*key, "island").agg(
        F.min_by(F.struct("id", "statement", "status"), F.struct(*order)).alias("h"),
        F.min_by("statement", F.when(sure, F.struct(*order))).alias("_s"),
        F.bool_or(sure).alias("_sure"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), "refs"))), lambda x: x["refs"]))).alias("refs"),
    )
    status = F.when(F.col("_sure"), "source_fact").otherwise(F.col("h.status"))
    return by.select(*key, "island", F.col("h.id").alias("id"), F.when(F.col("_sure") & (F.col("h.status") != "source_fact"), F.col("_s")).otherwise(F.col("h.statement")).alias("statement"), status.alias("status"), "refs")


def conflict_ids(rows: DataFrame, kind: str, scope: list[str], order: list[str]) -> DataFrame:
    """F-21: ``rows`` with conflict_id, conflict_<kind>_<number> from 001 in
    order within their scope."""
    n = F.row_number().over(W.partitionBy(*scope).orderBy(*order))
    return rows.withColumn("conflict_id", F.format_string(f"conflict_{kind}_%03d", n))


def upgrade_status(status: Column) -> Column:
    """Status of merged facts: certain as soon as one of them is."""
    return F.when(F.bool_or(status == "source_fact"), "source_fact").otherwise(F.min(status))


def timeline(events: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """F-08, F-13: events renumbered from 1 within their scope."""
    return events.withColumn("ord", F.row_number().over(W.partitionBy(*scope).orderBy(*order)))


def merge_timeline(state: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F-08: ((novel_id, id, summary, first, ord), (novel_id, id, rule)): events
    of a delta join a timeline by id.  The same event again changes nothing, a
    different one under its id is a conflict; all are ordered by first paragraph,
    then as they came, and numbered from 1.  Both: (novel_id, id, summary, first,
    ord)."""
    rows = state.withColumn("_p", F.lit(0)).unionByName(incoming.withColumn("_p", F.lit(1)))
    w = W.partitionBy("novel_id", "id").orderBy("_p", "ord")
    rows = rows.withColumn("_k", F.row_number().over(w)).withColumn("_first", F.first("summary").over(w))
    bad = rows.where((F.col("_k") > 1) & (norm_text(F.col("summary")) != norm_text(F.col("_first")))).select("novel_id", "id", F.lit("timeline_differs").alias("rule"))
    n = F.row_number().over(W.partitionBy("novel_id").orderBy(F.col("first").asc_nulls_last(), "_p", "_o"))
    return rows.where("_k = 1").withColumnRenamed("ord", "_o").withColumn("ord", n).select("novel_id", "id", "summary", "first", "ord"), bad


def ambiguous_order(events: DataFrame, at: list[str], key: Column) -> DataFrame:
    """F-13: positions that hold more than one distinct event."""
    return events.withColumn("_k", key).groupBy(*at).agg(F.count_distinct("_k").alias("keys")).where("keys > 1")


def thread_states(actions: DataFrame, thread: list[str], segment: str, action: str) -> DataFrame:
    """F-14, W-09: (thread, segment, opened, resolved, state, same_segment,
    reopened), one row for each segment in which a thread is opened or resolved.

    A segment that does both leaves the thread open and is a conflict, as is
    opening after a segment that left it resolved.
    """
    by = actions.groupBy(*thread, segment).agg(F.bool_or(F.col(action) == "open").alias("opened"), F.bool_or(F.col(action) == "resolved").alias("resolved")).where("opened or resolved")
    by = by.withColumn("state", F.when(F.col("opened"), "open").otherwise("resolved")).withColumn("same_segment", F.col("opened") & F.col("resolved"))
    before = F.lag("state").over(W.partitionBy(*thread).orderBy(segment))
    return by.withColumn("reopened", F.coalesce(F.col("opened") & (before == "resolved"), F.lit(False)))


def thread_summary(actions: DataFrame, thread: list[str], segment: str, action: str) -> DataFrame:
    """F-14: (thread, introduced, status, resolved_at), one row for each thread,
    also one that is only mentioned, which stays open."""
    seen = actions.groupBy(*thread).agg(F.min(segment).alias("introduced"))
    last = thread_states(actions, thread, segment, action).groupBy(*thread).agg(F.max_by(F.struct("state", segment), segment).alias("x"))
    done = F.col("x.state") == "resolved"
    got = seen.join(last, thread, "left")
    return got.select(*thread, "introduced", F.when(done, "resolved").otherwise("open").alias("status"), F.when(done, F.col(f"x.{segment}")).alias("resolved_at"))


SCALARS = {"scene": ("location", "timeLabel"), "character": ("location", "physicalState"), "object": ("holderCharacterId", "location", "state")}
SETS = {"character": ("knowledge", "activeGoals")}


def set_text(items: Column) -> Column:
    """K-04, T9: the canonical text of a set of strings; never empty."""
    return F.to_json(F.array_sort(F.array_distinct(items)))


def boundary_issues(states: DataFrame) -> DataFrame:
    """F-15, J-10, T9: (novel_id, issue_id, left_chunk, right_chunk, entity_type,
    entity_id, field, left_value, right_value) where a chunk starts and ends with
    different values, or ends with another than the next starts with.

    states: (novel_id, idx, chunk_id, side, entity_type, entity_id, field, value,
    items); items is the set of a set-valued field.  An empty scalar raises
    nothing, an empty set does; an entity that one side lacks is passed over.
    """
    v = F.when(F.col("items").isNotNull(), set_text(F.col("items"))).otherwise(F.nullif(F.col("value"), F.lit("")))
    rows = states.select("novel_id", "idx", "chunk_id", "side", "entity_type", "entity_id", "field", v.alias("v")).where("v is not null")
    side = lambda s, step, name: rows.where(F.col("side") == s).select("novel_id", (F.col("idx") * 2 + step).alias("at"), F.col("chunk_id").alias(f"{name}_chunk"), "entity_type", "entity_id", "field", F.col("v").alias(f"{name}_value"))
    on = ["novel_id", "at", "entity_type", "entity_id", "field"]
    within = side("entry", 0, "left").join(side("exit", 0, "right"), on)
    across = side("exit", 1, "left").join(side("entry", -1, "right"), on)
    got = within.unionByName(across).where(norm_text(F.col("left_value")) != norm_text(F.col("right_value")))
    name = F.concat_ws(":", F.lit("boundary"), "left_chunk", "right_chunk", "entity_type", "entity_id", "field")
    return got.select("novel_id", name.alias("issue_id"), "left_chunk", "right_chunk", "entity_type", "entity_id", "field", "left_value", "right_value")


def boundary_diff(states: DataFrame, scope: list[str], step: str, value: str) -> DataFrame:
    """F-15, J-09: (scope, step, exit, entry) where the value a step ends with
    differs from the one the next starts with; ``states`` has the columns
    ``value``_first and ``value``_last.  An empty side raises nothing."""
    w = W.partitionBy(*scope).orderBy(step)
    rows = states.select(*scope, step, F.col(f"{value}_last").alias("exit"), F.lead(f"{value}_first").over(w).alias("entry"))
    return rows.where(F.nullif(F.col("exit"), F.lit("")).isNotNull() & F.nullif(F.col("entry"), F.lit("")).isNotNull() & (norm_text(F.col("exit")) != norm_text(F.col("entry"))))


def partition_errors(members: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """U-06: (key, rule) for ids that a plan has twice, lacks or doesn't know."""
    n = members.groupBy(key).agg(F.count("*").alias("n"))
    twice = n.where("n > 1").select(key, F.lit("duplicate").alias("rule"))
    missing = expected.join(members, key, "left_anti").select(key, F.lit("missing").alias("rule"))
    unknown = n.join(expected, key, "left_anti").select(key, F.lit("unknown").alias("rule"))
    return twice.unionByName(missing).unionByName(unknown)


def priority_union(primary: DataFrame, secondary: DataFrame, key: list[str], value: str) -> DataFrame:
    """U-02: keys of both, the value of the later table where both have one."""
    rows = primary.select(*key, value, F.lit(1).alias("_p")).unionByName(secondary.select(*key, value, F.lit(2).alias("_p")))
    return rows.groupBy(*key).agg(F.max_by(value, "_p").alias(value))


def alias_collisions(names: DataFrame) -> DataFrame:
    """J-12, F-24: (name, ids) for normalised names that more than one id owns;
    ``names`` has (id, name)."""
    by = names.select("id", norm_text(F.col("name")).alias("name")).where("name <> ''").groupBy("name")
    return by.agg(F.count_distinct("id").alias("n"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids")).where("n > 1").select("name", "ids")


def open_references(refs: DataFrame) -> DataFrame:
    """F-20: (novel_id, id, text, candidates, n): open references of the same text
    and candidates, one conflict each, by first paragraph.  refs: (novel_id,
    text, candidates array, first)."""
    who = F.array_join(F.array_sort(F.array_distinct(F.coalesce("candidates", F.array().cast("array<string>")))), ",")
    by = refs.groupBy("novel_id", norm_text(F.col("text")).alias("_t"), who.alias("candidates")).agg(F.count("*").alias("n"), F.min_by("text", "first").alias("text"), F.min("first").alias("first"))
    return conflict_ids(by, "open_reference", ["novel_id"], ["first", "_t", "candidates"]).select("novel_id", F.col("conflict_id").alias("id"), "text", "candidates", "n")


def step(r, by_id: dict, active: dict) -> str:
    """What one fact does to the state (F-06): with an id seen before it merges
    if key and value agree, else it is a conflict; with the active fact's value
    it merges; it replaces the active fact that it supersedes; any other is a
    conflict and the active fact stays."""
    now = active.get(r.key)
    if r.id in by_id:
        return "merge" if by_id[r.id] == (r.key, r.value) else "conflict"
    if now is None or (now[1] != r.value and r.supersedes is not None and r.supersedes == now[0]):
        by_id[r.id] = (r.key, r.value)
        active[r.key] = (r.id, r.value)
        return "new" if now is None else "replace"
    return "merge" if now[1] == r.value else "conflict"


def normal(deltas: DataFrame) -> DataFrame:
    """Keys and values in the form in which they are compared."""
    return deltas.withColumns({"key": norm_text(F.col("key")), "value": norm_text(F.col("value"))})


def roll_facts(deltas: DataFrame) -> DataFrame:
    """F-06, M-01: (novel_id, ord, key, id, outcome, active) of the rolling merge
    of (novel_id, ord, key, id, value, supersedes) rows; keys and values are
    compared in normal form.  The state is what was last accepted, so this is a
    fold per novel."""

    def fold(pdf):
        import pandas as pd

        active: dict = {}
        by_id: dict = {}
        out = []
        for r in pdf.sort_values("ord").itertuples(index=False):
            outcome = step(r, by_id, active)
            out.append((r.novel_id, r.ord, r.key, r.id, outcome, active[r.key][0] if r.key in active else None))
        return pd.DataFrame(out, columns=["novel_id", "ord", "key", "id", "outcome", "active"])

    return normal(deltas).groupBy("novel_id").applyInPandas(fold, "novel_id string, ord long, key string, id string, outcome string, active string")


def chapter_of_refs(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """K-06, J-05: ``refs`` (chunk_id, start, end, ...) with chapter_id, that of the
    range (chunk_id, chapter_id, start, end) which holds the whole reference; null
    where it crosses ranges or lies outside."""
    r = ranges.select("chunk_id", "chapter_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    fits = (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    met = refs.select("chunk_id", "start", "end").distinct().join(r, "chunk_id").where(fits).groupBy("chunk_id", "start", "end").agg(F.min_by("chapter_id", "_s").alias("chapter_id"))
    return refs.join(met, ["chunk_id", "start", "end"], "left")
