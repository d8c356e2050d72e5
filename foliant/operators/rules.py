"""Rules over deltas and local extraction results (D-*, L-*), as violations.

Every rule is one query that gives rows (rule, path); the union of all is the
report.  Nothing fails fast: callers decide whether a non-empty report is fatal.
Inputs are flat tables with chunk_id throughout; refs is an array of
struct(chapter_id, chunk_id, start, end).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import fact_key, norm_text, scoped_id, utf16_units
from foliant.operators.batches import met
from foliant.operators.screenplay import blank
from foliant.sources.model import parse_json
from foliant.sources.stage import staged

#: The vocabularies of the model.
FACT_KINDS = ("character", "relationship", "timeline", "location", "object", "knowledge", "constraint")
STATUSES = ("source_fact", "uncertain")
ACTIONS = ("open", "mentioned", "resolved")
REASONS = ("state_change", "correction", "reveal")
SIDES = ("entry", "exit")
CHARACTER_KINDS = ("character", "relationship", "timeline", "location", "knowledge")
STORY_SUBJECTS = ("global:story", "story", "novel", "全书", "故事", "小说")
RESOLUTIONS = ("confirmed_existing", "confirmed_incoming", "state_change", "correction")
DELTA_LISTS = ("characters", "newFacts", "timelineEvents", "openedThreads", "resolvedThreads", "reportedConflicts", "resolvedConflicts")
LOCAL_LISTS = ("characters", "facts", "timelineEvents", "threadObservations")
DELTA_CHARS, BOUNDARY_CHARS = 200_000, 25_000


def _rows(df: DataFrame, when: Column, rule: str, path: Column) -> DataFrame:
    return df.where(when).select(F.lit(rule).alias("rule"), path.alias("path"))


def _at(table: str, *more: str) -> Column:
    return F.concat_ws("/", F.lit(table), "chunk_id", F.coalesce("id", F.lit("")), *(F.lit(m) for m in more))


def _report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def duplicate_ids(table: str, df: DataFrame) -> DataFrame:
    """D-05, L-03: ids used twice in one chunk."""
    by = df.groupBy("chunk_id", "id").agg(F.count("*").alias("n"))
    return _rows(by, F.col("n") > 1, "duplicate_id", _at(table))


def bad_refs(table: str, df: DataFrame, chunks: DataFrame) -> DataFrame:
    """D-11 .. D-15, L-17: no reference at all, one to another chunk, outside
    the chunk's core, or to a chapter that doesn't hold it.

    ``chunks``: chunk_id, start, end, chapters array<struct(id, start, end)>.
    """
    out = [_rows(df, F.coalesce(F.size("refs"), F.lit(0)) < 1, "refs_missing", _at(table))]
    each = df.select("chunk_id", "id", F.explode("refs").alias("r"))
    out.append(_rows(each, ~F.col("r.chunk_id").eqNullSafe(F.col("chunk_id")), "ref_chunk", _at(table)))
    got = each.join(chunks, "chunk_id")
    inside = (F.col("r.start") >= F.col("start")) & (F.col("r.end") <= F.col("end")) & (F.col("r.start") <= F.col("r.end"))
    out.append(_rows(got, ~F.coalesce(inside, F.lit(False)), "ref_core", _at(table)))
    known = F.exists("chapters", lambda c: c["id"] == F.col("r.chapter_id"))
    held = F.exists("chapters", lambda c: (c["id"] == F.col("r.chapter_id")) & (F.col("r.start") >= c["start"]) & (F.col("r.end") <= c["end"]))
    out.append(_rows(got, ~F.coalesce(known, F.lit(False)), "ref_chapter", _at(table)))
    out.append(_rows(got, F.coalesce(known & ~held, F.lit(False)), "ref_chapter_range", _at(table)))
    return _report(out)


def fact_rules(facts: DataFrame, characters: DataFrame) -> DataFrame:
    """D-16 .. D-19, D-22, L-05 .. L-10 on facts (chunk_id, id, kind,
    subject_id, predicate, value, statement, status, perspective_id,
    supersedes, reason)."""
    out = [_rows(facts, blank(F.col(c)), f"fact_{c}", _at("facts")) for c in ("id", "subject_id", "predicate", "value", "statement")]
    out.append(_rows(facts, ~F.coalesce(F.col("kind").isin(*FACT_KINDS), F.lit(False)), "fact_kind", _at("facts")))
    out.append(_rows(facts, ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "fact_status", _at("facts")))
    ids = characters.select("chunk_id", F.col("id").alias("_c")).distinct()
    own = facts.where(F.col("kind").isin(*CHARACTER_KINDS))
    out.append(_rows(own.join(ids, (own["chunk_id"] == ids["chunk_id"]) & (own["subject_id"] == ids["_c"]), "left_anti"), F.lit(True), "fact_subject", _at("facts")))
    bound = facts.where((F.col("kind") == "constraint") & ~norm_text(F.col("subject_id")).isin(*STORY_SUBJECTS))
    out.append(_rows(bound.join(ids, (bound["chunk_id"] == ids["chunk_id"]) & (bound["subject_id"] == ids["_c"]), "left_anti"), F.lit(True), "constraint_subject", _at("facts")))
    seen = facts.where(F.col("perspective_id").isNotNull())
    out.append(_rows(seen.join(ids, (seen["chunk_id"] == ids["chunk_id"]) & (seen["perspective_id"] == ids["_c"]), "left_anti"), F.lit(True), "fact_perspective", _at("facts")))
    reason = F.when(F.col("supersedes").isNull(), F.col("reason").isNotNull()).otherwise(~F.coalesce(F.col("reason").isin(*REASONS), F.lit(False)))
    out.append(_rows(facts, reason, "fact_reason", _at("facts")))
    return _report(out)


def supersession_rules(facts: DataFrame) -> DataFrame:
    """D-21, L-12: a superseded fact must exist in the chunk, come before, have
    the same key and be superseded once; ``facts`` has pos besides."""
    k = fact_key(F.col("kind"), F.col("subject_id"), F.col("predicate"), F.col("perspective_id"))
    f = facts.select("chunk_id", "id", "pos", "supersedes", k.alias("k"))
    target = f.select("chunk_id", F.col("id").alias("supersedes"), F.col("pos").alias("_pos"), F.col("k").alias("_k"))
    got = f.where("supersedes is not null").join(target, ["chunk_id", "supersedes"], "left")
    out = [
        _rows(got, F.col("_pos").isNull(), "supersedes_missing", _at("facts")),
        _rows(got, F.coalesce(F.col("_pos") >= F.col("pos"), F.lit(False)), "supersedes_order", _at("facts")),
        _rows(got, F.coalesce(F.col("_k") != F.col("k"), F.lit(False)), "supersedes_key", _at("facts")),
    ]
    twice = f.where("supersedes is not null").groupBy("chunk_id", F.col("supersedes").alias("id")).agg(F.count("*").alias("n"))
    out.append(_rows(twice, F.col("n") > 1, "supersedes_twice", _at("facts")))
    return _report(out)


def event_rules(events: DataFrame, characters: DataFrame) -> DataFrame:
    """D-23, L-13: summary, order from 1, and known characters."""
    out = [_rows(events, blank(F.col("summary")), "event_summary", _at("events")), _rows(events, F.coalesce(F.col("ord"), F.lit(0)) < 1, "event_order", _at("events"))]
    each = events.select("chunk_id", "id", F.explode("character_ids").alias("_c"))
    ids = characters.select("chunk_id", F.col("id").alias("_c")).distinct()
    out.append(_rows(each.join(ids, ["chunk_id", "_c"], "left_anti"), F.lit(True), "event_character", _at("events")))
    return _report(out)


def thread_rules(threads: DataFrame) -> DataFrame:
    """D-24, L-14."""
    return _report([_rows(threads, blank(F.col("summary")), "thread_summary", _at("threads")), _rows(threads, ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "thread_action", _at("threads"))])


def thread_resolution_rules(resolved: DataFrame, opened: DataFrame) -> DataFrame:
    """D-25: resolved threads must be known and open, and named once.  ``opened``:
    (id, status) of the state before."""
    known = resolved.join(opened, "id", "left")
    twice = resolved.groupBy("chunk_id", "id").agg(F.count("*").alias("n"))
    return _report([
        _rows(known, F.col("status").isNull(), "thread_unknown", _at("threads")),
        _rows(known, F.coalesce(F.col("status") != "open", F.lit(False)), "thread_not_open", _at("threads")),
        _rows(twice, F.col("n") > 1, "thread_twice", _at("threads")),
    ])


def boundary_rules(boundary: DataFrame, chunks: DataFrame, characters: DataFrame) -> DataFrame:
    """D-29 .. D-31, L-15, L-16 on boundary rows (chunk_id, side, as_of, id,
    entity_type, field, value): anchored at the chunk's first or last paragraph,
    entities known, holders too."""
    got = boundary.join(chunks.select("chunk_id", "start", "end"), "chunk_id", "left")
    anchor = F.when(F.col("side") == "entry", F.col("start")).when(F.col("side") == "exit", F.col("end"))
    out = [
        _rows(got, ~F.coalesce(F.col("side").isin(*SIDES), F.lit(False)), "boundary_side", _at("boundary")),
        _rows(got, F.col("start").isNull(), "boundary_chunk", _at("boundary")),
        _rows(got, F.coalesce(F.col("as_of") != anchor, F.lit(False)), "boundary_anchor", _at("boundary")),
    ]
    ids = characters.select("chunk_id", F.col("id").alias("_c")).distinct()
    who = boundary.where("entity_type = 'character'").withColumn("_c", F.col("id"))
    out.append(_rows(who.join(ids, ["chunk_id", "_c"], "left_anti"), F.lit(True), "boundary_character", _at("boundary")))
    holder = boundary.where("entity_type = 'object' and field = 'holderCharacterId' and value <> ''").withColumn("_c", F.col("value"))
    out.append(_rows(holder.join(ids, ["chunk_id", "_c"], "left_anti"), F.lit(True), "boundary_holder", _at("boundary")))
    twice = boundary.groupBy("chunk_id", "side", "entity_type", "id", "field").agg(F.count("*").alias("n"))
    out.append(_rows(twice, F.col("n") > 1, "boundary_twice", _at("boundary")))
    return _report(out)


def _filled(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def conflict_report(closed: DataFrame, conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    """D-27, D-28: the rules of ``conflict_rules`` and ``closing_rules``.

    A conflict meets its row, then the fact that closes it, then the existing one;
    each of these steps is written with what it found, so that the files of one
    shuffle are gone before the next and no row is moved for a rule of its own.
    """
    closed = _filled(closed, "chunk_id", "id", "resolution", "explanation", "fact_id")
    conflicts = _filled(conflicts, "id", "status", "existing_id", "incoming_value")
    facts = _filled(facts, "id", "key", "value", "supersedes")
    kind = F.col("resolution")
    one = W.partitionBy("id", "chunk_id")
    c = closed.repartition("id").withColumns({"_n": F.count("*").over(one), "_k": F.row_number().over(one.orderBy("chunk_id"))})
    open_ = F.coalesce(F.col("status") == "open", F.lit(False))
    o = conflicts.repartition("id").select("id", open_.alias("_open"), "existing_id", F.col("incoming_value").alias("_in"))
    o = o.withColumn("_j", F.row_number().over(W.partitionBy("id").orderBy(F.col("_open").desc())))  # open ones first
    is_open = F.coalesce("_open", F.lit(False))
    first = F.coalesce(F.col("_j") == 1, F.lit(True))
    found = (
        (~is_open, "conflict_not_open"),
        (first & blank(F.col("explanation")), "conflict_explanation"),
        (first & (F.col("_n") > 1) & (F.col("_k") == 1), "conflict_twice"),
        (first & ~F.coalesce(kind.isin(*RESOLUTIONS), F.lit(False)), "conflict_resolution"),
        (first & blank(F.col("fact_id")), "conflict_fact_missing"),
    )
    met_row = staged(c.join(met(o), "id", "left").select(
        "chunk_id", "id", "resolution", "fact_id", F.when(is_open, F.col("existing_id")).alias("existing_id"), F.when(is_open, F.col("_in")).alias("_in"),
        first.alias("_first"), (is_open | first).alias("_goes_on"), F.array_compact(F.array(*(F.when(when, rule) for when, rule in found))).alias("found"),
    ))

    same = lambda a, b: norm_text(F.col(a)) == norm_text(F.col(b))
    new = facts.select(F.col("id").alias("fact_id"), F.col("key").alias("_nk"), F.col("value").alias("_nv"), F.col("supersedes").alias("_s"), F.lit(True).alias("_there"))
    after = F.coalesce(F.col("_s") == F.col("existing_id"), F.lit(False))
    fits = F.when(kind == "confirmed_incoming", same("_nv", "_in") & after).when(kind.isin("state_change", "correction"), after).otherwise(True)
    confirms = F.coalesce(kind == "confirmed_existing", F.lit(False))
    met_new = staged(met_row.where("_goes_on").join(met(new), "fact_id", "left").select(
        "chunk_id", "id", "existing_id", F.col("_in").isNotNull().alias("_sided"), "_nk", F.when(confirms, F.col("_nv")).alias("_nv"),
        confirms.alias("_confirms"), fits.alias("_fits"), (F.col("_first") & F.col("fact_id").isNotNull() & F.col("_there").isNull()).alias("_absent"),
    ))

    old = facts.select(F.col("id").alias("existing_id"), F.col("key").alias("_k"), F.col("value").alias("_v"))
    sided = F.col("_sided") & F.col("_k").isNotNull()
    fits = same("_nk", "_k") & F.when(F.col("_confirms"), same("_nv", "_v")).otherwise(F.col("_fits"))
    rule = F.when(~sided, "conflict_unstructured").when(F.col("_nk").isNotNull() & ~fits, "conflict_fact_unrelated")
    both = met_new.drop("_absent").join(met(old), "existing_id", "left").select(rule.alias("rule"), _at("conflicts").alias("path"))
    return _report([
        met_row.select(F.explode("found").alias("rule"), _at("conflicts").alias("path")),
        _rows(met_new, F.col("_absent"), "conflict_fact", _at("conflicts")),
        both.where("rule is not null"),
    ])


def conflict_rules(closed: DataFrame, opened: DataFrame, facts: DataFrame) -> DataFrame:
    """D-27, D-28: a conflict is closed once, must be open, needs an explanation
    and, if a fact settles it, one that exists.  ``closed``: (chunk_id, id,
    resolution, explanation, fact_id)."""
    return conflict_report(closed, opened, facts).where(F.col("rule").isin("conflict_not_open", "conflict_explanation", "conflict_fact", "conflict_twice"))


def closing_rules(closed: DataFrame, conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    """D-27, D-28: a conflict is closed by a fact, with a known resolution, and
    only if it has both sides; the fact must have the existing one's key, and its
    value (confirmed_existing), the incoming one's value and supersede the
    existing one (confirmed_incoming), or supersede it (other resolutions).

    closed (chunk_id, id, resolution, fact_id), conflicts (id, status,
    existing_id, incoming_value), facts (id, key, value, supersedes).
    """
    return conflict_report(closed, conflicts, facts).where(F.col("rule").isin("conflict_resolution", "conflict_fact_missing", "conflict_unstructured", "conflict_fact_unrelated"))


def _kind(path: str, v: str | Column = "v") -> Column:
    name = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return F.coalesce(F.lower(F.regexp_extract(name, "^[A-Z]+", 0)), F.lit("missing"))


def _strings(path: str, v: str | Column = "v") -> Column:
    """Whether there is an array of nothing but strings at ``path``."""
    return F.coalesce(F.schema_of_variant(F.variant_get(v, path, "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))


def _text(path: str, v: str | Column = "v") -> Column:
    return F.when(_kind(path, v) == "string", F.try_variant_get(v, path, "string"))


def _items(path: str, v: str | Column = "v") -> Column:
    """(i, v) of the objects of a list, with their places in it."""
    all_ = F.when(_kind(path, v) == "array", F.variant_get(v, path, "array<variant>"))
    placed = F.transform(F.coalesce(all_, F.array().cast("array<variant>")), lambda x, i: F.struct(i.alias("i"), x.alias("v")))
    return F.filter(placed, lambda x: _kind("$", x["v"]) == "object")


def _path(kind: str, *places: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), "chunk_id", F.format_string(kind, *places) if places else F.lit(kind))


#: What is wrong with an answer: (rule, path) of each rule (when, rule, path).
FOUND = "array<struct<rule:string,path:string>>"


def _found(*rules: tuple[Column, str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(when, F.struct(F.lit(rule).alias("rule"), path.alias("path"))) for when, rule, path in rules))).cast(FOUND)


def _of_items(items: Column, rules) -> Column:
    """What ``rules`` (an item's value and place to its rules) find in a list."""
    return F.flatten(F.transform(items, lambda x: _found(*rules(x["v"], x["i"])))).cast(FOUND)


def _answers(raw: DataFrame, most: int | None, lists: tuple[str, ...], span: str, chunks: DataFrame, found: list[Column], **kept: Column) -> DataFrame:
    """The answers of ``chunks`` with found, what is wrong with each, and with what
    is ``kept`` of those that are objects.  ``found`` and ``kept`` are columns of
    the parsed text v.  A text is parsed once, where it lies: nothing of it is
    written or joined but what is found and kept."""
    parsed = raw.select("chunk_id", utf16_units(F.col("raw")).alias("size"), parse_json(F.col("raw")).alias("v"))
    whole = F.col("v").isNotNull() & (_kind("$") == "object")
    broken = [(F.col("v").isNull(), "invalid_json", _path("")), (F.col("v").isNotNull() & (_kind("$") != "object"), "root", _path(""))]
    if most is not None:
        broken.append((F.col("size") > most, "too_long", _path("")))
    shape = [(~F.coalesce(_text("$.chunkId") == F.col("chunk_id"), F.lit(False)), "chunk_id", _path("chunkId")), *((_kind(f"$.{k}") != "array", "list_missing", _path(k)) for k in lists)]
    all_ = F.concat(_found(*broken), F.when(whole, F.concat(_found(*shape), *found)).otherwise(F.array().cast(FOUND)))
    edges = {f"_{k}": F.when(whole, F.try_variant_get("v", f"$.{span}.{k}", "double")) for k in ("start", "end")}
    made = parsed.select("chunk_id", whole.alias("_whole"), all_.alias("found"), *(c.alias(k) for k, c in edges.items()), *(F.when(whole, c).alias(k) for k, c in kept.items()))
    rows = staged(made).join(chunks.select("chunk_id", "start", "end"), "chunk_id")
    exact = F.coalesce((F.col("_start") == F.col("start")) & (F.col("_end") == F.col("end")), F.lit(False))
    return rows.withColumn("found", F.concat("found", _found((F.col("_whole") & ~exact, "range", _path(span))))).drop("_whole", "_start", "_end", "start", "end")


def _told(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("found").alias("x")).select("x.rule", "x.path")


def _character_shapes(*more) -> Column:
    """``more``: of a character's value and place, a further rule."""
    return _of_items(_items("$.characters"), lambda v, i: [
        (blank(_text("$.name", v)), "character_name", _path("characters[%d].name", i)),
        (~_strings("$.aliases", v), "character_aliases", _path("characters[%d].aliases", i)),
        (~_kind("$.description", v).isin("string", "missing"), "character_description", _path("characters[%d].description", i)),
        *(rule(v, i) for rule in more),
    ])


def delta_shapes(raw: DataFrame, chunks: DataFrame, known: DataFrame) -> DataFrame:
    """D-01 .. D-04, D-06 .. D-10, D-20, D-26, D-29, D-32 .. D-35 on the texts of
    deltas: raw (chunk_id, raw), chunks (chunk_id, start, end, done: the last
    paragraph processed before), known (id, name): the characters so far."""
    has_state = _kind("$.boundaryState") == "object"
    loose = _items("$.boundaryState.openReferences")
    found = [
        _character_shapes(lambda v, i: (_kind("$.identityStatus", v) != "missing", "server_field", _path("characters[%d].identityStatus", i))),
        _of_items(_items("$.newFacts"), lambda v, i: [(_kind("$.supersededByFactId", v) != "missing", "server_field", _path("newFacts[%d].supersededByFactId", i))]),
        _of_items(_items("$.reportedConflicts"), lambda v, i: [(blank(_text("$.description", v)), "conflict_description", _path("reportedConflicts[%d].description", i))]),
        _found(
            (~has_state, "boundary_missing", _path("boundaryState")),
            (has_state & (utf16_units(F.to_json(F.variant_get("v", "$.boundaryState", "variant"))) > BOUNDARY_CHARS), "boundary_size", _path("boundaryState")),
            *((has_state & (_kind(f"$.boundaryState.{k}") != "array"), "list_missing", _path(f"boundaryState.{k}")) for k in ("characters", "objects", "openReferences")),
            *((has_state & ~_kind(f"$.boundaryState.{k}").isin("string", "missing"), "boundary_label", _path(f"boundaryState.{k}")) for k in ("timeLabel", "location")),
        ),
        _of_items(loose, lambda v, i: [
            (blank(_text("$.text", v)), "reference_text", _path("boundaryState.openReferences[%d].text", i)),
            (~_strings("$.candidateCharacterIds", v), "reference_candidates", _path("boundaryState.openReferences[%d].candidateCharacterIds", i)),
        ]),
    ]
    people = F.transform(_items("$.characters"), lambda x: F.struct(x["i"].alias("i"), _text("$.id", x["v"]).alias("id"), _text("$.name", x["v"]).alias("name")))
    named_in = F.transform(F.filter(loose, lambda x: _strings("$.candidateCharacterIds", x["v"])), lambda x: F.struct(x["i"].alias("i"), F.variant_get(x["v"], "$.candidateCharacterIds", "array<string>").alias("ids")))
    rows = _answers(raw, DELTA_CHARS, DELTA_LISTS, "processedRange", chunks, found, people=people, loose=named_in)
    out = [_told(rows)]
    asked = raw.select("chunk_id").join(chunks, "chunk_id")
    out.append(_rows(asked, F.col("start") != F.coalesce("done", F.lit(0)) + 1, "continuity", _path("processedRange")))
    named = rows.select("chunk_id", F.explode("people").alias("p")).select("chunk_id", "p.i", "p.id", F.col("p.name").alias("_n")).join(known.select("id", "name"), "id")
    out.append(_rows(named, F.coalesce(norm_text(F.col("_n")) != "", F.lit(False)) & (norm_text(F.col("_n")) != norm_text(F.col("name"))), "character_renamed", _path("characters[%d].name", F.col("i"))))
    own = F.coalesce(F.transform("people", lambda p: p["id"]), F.array().cast("array<string>"))
    each = rows.select("chunk_id", own.alias("own"), F.explode("loose").alias("l")).select("chunk_id", "own", "l.i", F.explode("l.ids").alias("id"))
    strange = each.where(~F.coalesce(F.array_contains("own", F.col("id")), F.lit(False))).drop("own").join(known.select("id"), "id", "left_anti")
    out.append(_rows(strange, F.lit(True), "reference_unknown", _path("boundaryState.openReferences[%d].candidateCharacterIds", F.col("i"))))
    return _report(out)


def local_shapes(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """L-01, L-02, L-04, L-11 on the texts of local results: raw (chunk_id, raw),
    chunks (chunk_id, start, end)."""
    facts = _of_items(_items("$.facts"), lambda v, i: [(_kind("$.supersededByFactId", v) != "missing", "server_field", _path("facts[%d].supersededByFactId", i))])
    return _told(_answers(raw, None, LOCAL_LISTS, "coreRange", chunks, [_character_shapes(), facts]))


def scoped_rules(characters: DataFrame, facts: DataFrame, objects: DataFrame) -> DataFrame:
    """L-18, L-19: ids that are the same once they have their chunk in front, and
    fact values that are a character's id and an object's.  characters and
    objects (chunk_id, id), facts (chunk_id, id, value)."""
    out = []
    for table, df in (("characters", characters), ("facts", facts), ("objects", objects.distinct())):
        by = df.select("chunk_id", "id").distinct() if table != "objects" else df.select("chunk_id", "id")
        by = by.groupBy("chunk_id", scoped_id(F.col("chunk_id"), F.col("id")).alias("id")).agg(F.count("*").alias("n"))
        out.append(_rows(by, F.col("n") > 1, "scoped_twice", _at(table)))
    both = characters.select("chunk_id", F.col("id").alias("value")).distinct().join(objects.select("chunk_id", F.col("id").alias("value")).distinct(), ["chunk_id", "value"])
    out.append(_rows(facts.join(both, ["chunk_id", "value"], "left_semi"), F.lit(True), "value_ambiguous", _at("facts")))
    return _report(out)


def global_subject(kind: Column, subject: Column) -> Column:
    """P-11: the one id of the story itself, however a constraint spells it."""
    return F.when((kind == "constraint") & norm_text(subject).isin(*STORY_SUBJECTS), "global:story").otherwise(subject)
