"""Boundary repair (F-16 .. F-21) and the relevance snapshot (F-22, P-05 .. P-07)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.text import canonical_predicate, fact_key, norm_text
from foliant.operators.knowledge import conflict_ids
from foliant.operators.paging import budget_pick, halved_blocks

BATCH_ISSUES, BATCH_CHARS = 40, 120_000
#: Entity and boundary field, and the predicate of the facts that speak of it.
FIELD_PREDICATES = {
    "character.location": "current_location",
    "character.physicalState": "physical_state",
    "object.holderCharacterId": "holder",
    "object.location": "current_location",
    "object.state": "state",
}


def allowed_transitions(issues: DataFrame, facts: DataFrame) -> DataFrame:
    """F-16, P-12, P-13: (issue_id, existing_id, incoming_id): pairs of facts of
    one key about an issue's entity that account for its change.

    A scalar field needs facts with its predicate and the values of the two
    sides; knowledge a changed term of two characters or more in either fact's
    text; goals the one fact's value among the old goals, the other's among the
    new.  issues (issue_id, entity_type, entity_id, field, exit, entry), facts
    (id, kind, subject_id, predicate, value, statement, perspective_id); lists
    are JSON texts.
    """
    pred = F.create_map(*(F.lit(x) for p in FIELD_PREDICATES.items() for x in p))[F.concat_ws(".", "entity_type", "field")]
    i = issues.select("*", pred.alias("_p"), norm_text(F.col("entity_id")).alias("_s"))
    key = fact_key(F.col("kind"), F.col("subject_id"), F.col("predicate"), F.col("perspective_id"))
    told = norm_text(F.concat_ws(" ", "predicate", "value", "statement"))
    f = facts.select("id", "kind", norm_text(F.col("subject_id")).alias("_s"), key.alias("_k"), canonical_predicate(F.col("predicate")).alias("_f"), norm_text(F.col("value")).alias("_v"), told.alias("_t"))
    old = f.select("_s", "_k", F.col("kind").alias("kind"), "_f", F.col("id").alias("existing_id"), F.col("_v").alias("_a"), F.col("_t").alias("_ta"))
    new = f.select("_k", F.col("id").alias("incoming_id"), F.col("_v").alias("_b"), F.col("_t").alias("_tb"))
    # a field's issues have one kind of rule each; for scalars the values are keys of the joins, so no pair is made that doesn't account for the change
    asked = i.where("_p is not null").select("issue_id", "_s", F.col("_p").alias("_f"), norm_text(F.col("exit")).alias("_a"), norm_text(F.col("entry")).alias("_b"))
    scalar = asked.join(old.select("_s", "_k", "_f", "_a", "existing_id"), ["_s", "_f", "_a"]).join(new.select("_k", "_b", "incoming_id"), ["_k", "_b"])
    by_lists = i.where("entity_type = 'character' and field in ('knowledge', 'activeGoals')")
    got = by_lists.join(old.where("kind in ('knowledge', 'constraint', 'character')"), "_s").join(new, "_k")
    terms = lambda c: F.transform(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), norm_text)
    said = F.concat("_ta", "_tb")
    knows = (F.col("field") == "knowledge") & (F.col("kind") == "knowledge") & F.exists(changed_terms(terms("exit"), terms("entry")), lambda t: (F.length(t) >= 2) & F.contains(said, t))
    goal = (F.col("field") == "activeGoals") & F.col("kind").isin("constraint", "character") & F.array_contains(terms("exit"), F.col("_a")) & F.array_contains(terms("entry"), F.col("_b")) & (F.col("_a") != F.col("_b"))
    out = ["issue_id", "existing_id", "incoming_id"]
    return scalar.where("existing_id <> incoming_id").select(*out).unionByName(got.where("existing_id <> incoming_id").where(knows | goal).select(*out))


def changed_terms(left: Column, right: Column) -> Column:
    """U-05: terms of one list and not of the other."""
    return F.array_sort(F.array_union(F.array_except(left, right), F.array_except(right, left)))


def repair_batches(issues: DataFrame, most: int = BATCH_ISSUES, chars: int = BATCH_CHARS) -> DataFrame:
    """F-17, O-09: ``issues`` (chunk_pair, issue_id, size) with batch: per pair of
    chunks ``most`` issues at a time, halved until they have at most ``chars``
    characters; an issue that is too large stands alone."""
    return halved_blocks(issues.select("chunk_pair", "issue_id", "size"), ["chunk_pair"], "issue_id", "size", most, chars, "batch").select("chunk_pair", "issue_id", "batch")


def apply_answers(issues: DataFrame, answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """F-18: (issue_id, decision, existing_id, incoming_id): an answer without references is
    unresolved, a state change needs an allowed transition, any decision but
    continuous and state_change leaves the issue open, as does no answer."""
    a = answers.join(allowed.withColumn("ok", F.lit(True)), ["issue_id", "existing_id", "incoming_id"], "left")
    got = issues.select("issue_id").join(a, "issue_id", "left")
    fine = F.coalesce(F.col("n_refs"), F.lit(0)) > 0
    decision = F.when(fine & (F.col("decision") == "continuous"), "continuous").when(fine & (F.col("decision") == "state_change") & F.coalesce("ok", F.lit(False)), "state_change").otherwise("unresolved")
    return got.select("issue_id", decision.alias("decision"), *(F.when(decision == "state_change", F.col(c)).alias(c) for c in ("existing_id", "incoming_id")))


def apply_transitions(conflicts: DataFrame, transitions: DataFrame) -> DataFrame:
    """F-19: (key, ord, conflict_id, closed, active): each key's transitions in
    order; one closes its conflict if it starts from the value now active, and
    then its value is active, which may enable the next.

    conflicts (key, active), transitions (key, ord, conflict_id, from_value,
    to_value).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, now = [], pdf["active"].iloc[0]
        for r in pdf.sort_values("ord").itertuples(index=False):
            closed = r.from_value == now
            now = r.to_value if closed else now
            out.append((r.key, r.ord, r.conflict_id, closed, now))
        return pd.DataFrame(out, columns=["key", "ord", "conflict_id", "closed", "active"])

    rows = transitions.join(conflicts, "key")
    return rows.groupBy("key").applyInPandas(fold, "key string, ord long, conflict_id string, closed boolean, active string")


def apply_state_changes(facts: DataFrame, conflicts: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F-19: (facts, conflicts) after the issues' state changes, in their order.

    A change applies to an open conflict of its two facts if the existing fact is
    still in force and the incoming one isn't a fact yet.  Then the incoming fact
    is added, superseding the other, and the conflict is resolved; that may enable
    the next change.  facts (novel_id, id, key, value, superseded_by), conflicts
    (novel_id, conflict_id, existing_id, incoming_id, key, value), transitions
    (novel_id, ord, existing_id, incoming_id).  Results: (novel_id, id, key,
    value, supersedes, superseded_by, reason) and (novel_id, conflict_id, status,
    resolved_by).
    """
    none = F.lit(None).cast("string")
    rows = facts.select("novel_id", F.lit(0).alias("what"), F.lit(0).cast("long").alias("ord"), "id", none.alias("other"), "key", "value", F.col("superseded_by").alias("extra"))
    rows = rows.unionByName(conflicts.select("novel_id", F.lit(1).alias("what"), F.lit(0).cast("long").alias("ord"), F.col("incoming_id").alias("id"), F.col("existing_id").alias("other"), "key", "value", F.col("conflict_id").alias("extra")))
    rows = rows.unionByName(transitions.select("novel_id", F.lit(2).alias("what"), F.col("ord").cast("long").alias("ord"), F.col("incoming_id").alias("id"), F.col("existing_id").alias("other"), none.alias("key"), none.alias("value"), none.alias("extra")))
    # a partition's novels come one after the other, each its facts, its conflicts and its changes in order: batches hold many novels, and a task one
    rows = rows.repartition("novel_id").sortWithinPartitions("novel_id", "what", F.asc_nulls_last("ord"), F.asc_nulls_last("id"))

    def folded(told: Callable[[str | None, dict, dict], Iterator[tuple]], columns: list[str]):
        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, begun = None, False
            held: dict[str, list] = {}  # id: [key, value, supersedes, superseded_by, reason]
            open_: dict[tuple, tuple] = {}
            status: dict[str, tuple] = {}
            for pdf in frames:
                out: list[tuple] = []
                for novel, what, ident, other, key, value, extra in zip(*(pdf[c].tolist() for c in ("novel_id", "what", "id", "other", "key", "value", "extra")), strict=True):
                    if not begun or novel != now:
                        out += told(now, held, {x: status.get(x, ("open", None)) for _, _, x in open_.values()}) if begun else []
                        now, begun, held, open_, status = novel, True, {}, {}, {}
                    if what == 0:
                        held[ident] = [key, value, None, extra, None]
                    elif what == 1:
                        open_[other, ident] = (key, value, extra)
                    else:
                        c, old = open_.get((other, ident)), held.get(other)
                        if c is None or old is None or old[3] is not None or ident in held or old[0] != c[0]:
                            continue
                        old[3] = ident
                        held[ident] = [c[0], c[1], other, None, "state_change"]
                        status[c[2]] = ("resolved", ident)
                yield pd.DataFrame(out, columns=columns)
            if begun:
                yield pd.DataFrame(list(told(now, held, {x: status.get(x, ("open", None)) for _, _, x in open_.values()})), columns=columns)

        kind = rows.schema["novel_id"].dataType.simpleString()
        return rows.mapInPandas(task, f"novel_id {kind}, " + ", ".join(f"{c} string" for c in columns[1:]))

    after = folded(lambda novel, held, _: ((novel, i, *v) for i, v in held.items()), ["novel_id", "id", "key", "value", "supersedes", "superseded_by", "reason"])
    return after, folded(lambda novel, _, status: ((novel, i, s, by) for i, (s, by) in status.items()), ["novel_id", "conflict_id", "status", "resolved_by"])


def residual_conflicts(decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """F-20: the issues of a novel that stay unresolved, as conflicts numbered in
    their order; decisions (issue_id, decision), issues (novel_id, ord,
    issue_id, ...)."""
    left = issues.join(decisions.where("decision = 'unresolved'").select("issue_id"), "issue_id", "left_semi")
    return conflict_ids(left, "boundary", ["novel_id"], ["ord", "issue_id"])


#: F-21: the order in which the kinds of conflicts are listed.
CONFLICT_ORDER = ("identity_pagination", "identity", "object_identity", "thread_identity", "fact", "timeline", "thread", "boundary", "open_reference")


def conflict_list(parts: dict[str, DataFrame]) -> DataFrame:
    """F-21: (novel_id, ord, kind, conflict_id): all conflicts of a novel in fixed
    order of their kinds; each part has (novel_id, conflict_id)."""
    rows = [d.select("novel_id", F.lit(CONFLICT_ORDER.index(k)).alias("_k"), F.lit(k).alias("kind"), "conflict_id") for k, d in parts.items()]
    n = F.row_number().over(W.partitionBy("novel_id").orderBy("_k", "conflict_id"))
    return reduce(DataFrame.unionByName, rows).withColumn("ord", n).select("novel_id", "ord", "kind", "conflict_id")


def active(facts: DataFrame) -> DataFrame:
    """P-05: facts that no other supersedes."""
    return facts.where("superseded_by is null")


def still_open(rows: DataFrame) -> DataFrame:
    """P-07: threads or conflicts that are open."""
    return rows.where("status = 'open'")


def mentioned(characters: DataFrame, boundary: DataFrame, facts: DataFrame, text: DataFrame) -> DataFrame:
    """P-06: (novel_id, chunk_id, id) of the characters that matter to a chunk:
    those of whom a name or alias is in its text, those of the boundary state
    before it, and, in order of the active facts, each character that is the
    value of a fact about one of them.

    characters (novel_id, ord, id, name, aliases), boundary (novel_id, chunk_id,
    id), facts (novel_id, ord, subject_id, value, superseded_by), text (novel_id,
    chunk_id, text).
    """
    names = characters.select("novel_id", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("novel_id", "id", norm_text(F.col("n")).alias("n")).where("n <> ''").distinct()
    told = text.select("novel_id", "chunk_id", norm_text(F.col("text")).alias("t"))
    by_novel = names.groupBy("novel_id").agg(F.collect_list(F.struct("id", "n")).alias("names"))
    named = told.join(by_novel, "novel_id").select("novel_id", "chunk_id", F.explode(F.array_distinct(F.transform(F.filter("names", lambda x: F.contains(F.col("t"), x["n"])), lambda x: x["id"]))).alias("id"))
    start = named.unionByName(boundary.select("novel_id", "chunk_id", "id")).distinct()
    links = active(facts).join(characters.select("novel_id", F.col("id").alias("value")).distinct(), ["novel_id", "value"], "left_semi")
    links = links.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("ord", "subject_id", "value"))).alias("links"))
    by = start.groupBy("novel_id", "chunk_id").agg(F.collect_set("id").alias("ids")).join(links, "novel_id", "left")
    more = F.aggregate(F.coalesce("links", F.array().cast(links.schema["links"].dataType)), F.col("ids"), lambda a, x: F.when(F.array_contains(a, x["subject_id"]), F.array_union(a, F.array(x["value"]))).otherwise(a))
    return by.select("novel_id", "chunk_id", F.explode(more).alias("id"))


def relevant_facts(facts: DataFrame, who: DataFrame, text: DataFrame) -> DataFrame:
    """P-06: (novel_id, chunk_id, id) of active facts that are constraints or whose
    subject or perspective is among a chunk's characters ``who``."""
    live = active(facts)
    by = lambda c: live.join(who.withColumnRenamed("id", c), ["novel_id", c]).select("novel_id", "chunk_id", "id")
    always = live.where("kind = 'constraint'").join(text.select("novel_id", "chunk_id"), "novel_id").select("novel_id", "chunk_id", "id")
    return by("subject_id").union(by("perspective_id")).union(always).distinct()


#: The characters that each section of a snapshot may take.
SECTIONS = {"characterIndex": 7_000, "relevantCharacters": 10_000, "activeFactIndex": 11_000, "relevantFacts": 24_000, "timelineIndex": 7_000, "recentTimeline": 10_000, "openThreads": 8_000, "openConflicts": 16_000}
RECENT = 40


def snapshot(characters: DataFrame, facts: DataFrame, timeline: DataFrame, threads: DataFrame, conflicts: DataFrame, boundary: DataFrame, text: DataFrame, sections: dict[str, int] | None = None) -> DataFrame:
    """F-22, O-03 .. O-05, U-02: (novel_id, chunk_id, section, pos, id, item,
    taken): what a novel's knowledge base shows a chunk, item by item as JSON in
    order, and whether the item still fits its section's budget.

    Characters that matter come first, then all from the last; facts likewise,
    both from the last; events, open threads and open conflicts from the last,
    of events also the RECENT last in full.  Tables have novel_id, ord and id;
    their columns are what is shown.  See ``mentioned`` for the others.
    """
    most = sections or SECTIONS
    chunks = text.select("novel_id", "chunk_id").distinct()
    who = mentioned(characters, boundary, facts, text)
    of_chunk = ["novel_id", "chunk_id", "id"]
    hit = who.withColumn("_hit", F.lit(True)).distinct()
    people = characters.withColumn("identity_status", F.coalesce("identity_status", F.lit("confirmed"))).join(chunks, "novel_id").join(hit, of_chunk, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    live = active(facts).drop("superseded_by").join(chunks, "novel_id")
    live = live.join(relevant_facts(facts, who, text).withColumn("_hit", F.lit(True)), of_chunk, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    late = lambda d: d.join(chunks, "novel_id")

    def section(rows: DataFrame, name: str, order: list[Column], columns: list[str] | None = None, head: int | None = None) -> DataFrame:
        shown = columns or [c for c in rows.columns if c not in ("novel_id", "chunk_id", "ord", "_hit")]
        pos = F.row_number().over(W.partitionBy("novel_id", "chunk_id").orderBy(*order))
        made = rows.withColumn("pos", pos).select("novel_id", "chunk_id", F.lit(name).alias("section"), "pos", F.col("id").cast("string").alias("id"), F.to_json(F.struct(*shown)).alias("item"))
        return made if head is None else made.where(F.col("pos") <= head)

    first = F.when(F.col("_hit"), F.col("ord")).otherwise(-F.col("ord"))
    last = F.col("ord").desc()
    rows = [
        section(people, "characterIndex", [F.col("_hit").desc(), first], ["id", "name", "aliases", "identity_status"]),
        section(people.where("_hit"), "relevantCharacters", [F.col("ord")], ["id", "name", "aliases", "description", "identity_status"]),
        section(live, "activeFactIndex", [F.col("_hit").desc(), last], ["id", "kind", "subject_id", "predicate", "value", "status", "perspective_id"]),
        section(live, "relevantFacts", [F.col("_hit").desc(), last]),
        section(late(timeline), "timelineIndex", [last], ["id", "summary", "ord", "character_ids"]),
        section(late(timeline), "recentTimeline", [last], None, RECENT),
        section(late(still_open(threads)), "openThreads", [last]),
        section(late(still_open(conflicts)), "openConflicts", [last]),
    ]
    items = reduce(DataFrame.unionByName, rows).withColumn("size", T.utf16_units(F.col("item")) + 1)
    budget = F.create_map(*(F.lit(x) for p in most.items() for x in p))[F.col("section")] - 1
    return budget_pick(items, ["novel_id", "chunk_id", "section"], "pos", "size", budget).drop("size")


def snapshot_counts(shown: DataFrame) -> DataFrame:
    """F-22: (novel_id, chunk_id, section, taken, omitted)."""
    return shown.groupBy("novel_id", "chunk_id", "section").agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("omitted"))
