"""Scoping, identity candidates, plans and canonical rewrites (F-01 .. F-04,
F-07, F-09 .. F-12, O-08).

Tables have a column novel_id unless a function says otherwise; every order and
numbering is within a novel.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import PILCROW, norm_text, scoped_id
from foliant.operators.headings import let
from foliant.sources.model import json_text, parse_json
from foliant.sources.stage import staged

#: Pronouns that are nobody's name, and the kinds of identity with their lists, name fields and ids.
PRONOUNS = ("他", "她", "它", "他们", "她们", "其", "此人")
PLAN_LISTS = {"char": ("groups", "canonicalName"), "object": ("objectGroups", "canonicalName"), "thread": ("threadGroups", "canonicalSummary")}
PAGE, PAGE_CHARS = 100, 120_000
SNIPPET_CHARS = 600
NO_PARAGRAPH = (1 << 53) - 1
_GROUP = "array<struct<memberIds:array<string>,canonicalName:string,canonicalSummary:string,aliases:array<string>,decision:string>>"
PLAN = f"struct<groups:{_GROUP},objectGroups:{_GROUP},threadGroups:{_GROUP}>"


def scope(rows: DataFrame, columns: list[str], chunk: str = "chunk_id") -> DataFrame:
    """F-01: local ids in ``columns`` prefixed by their chunk; arrays too."""
    kinds = dict(rows.dtypes)
    made = {c: F.transform(c, lambda x: scoped_id(F.col(chunk), x)) if kinds[c].startswith("array") else scoped_id(F.col(chunk), F.col(c)) for c in columns}
    return rows.withColumns(made)


def first_paragraph(refs: Column) -> Column:
    """A-05: the first paragraph that an array of references speaks of; one
    beyond all where there is none."""
    return F.coalesce(F.array_min(F.transform(refs, lambda r: r["start"].cast("long"))), F.lit(NO_PARAGRAPH))


def last_paragraph(refs: Column) -> Column:
    return F.array_max(F.transform(refs, lambda r: r["end"].cast("long")))


def object_candidates(boundary: DataFrame, facts: DataFrame) -> DataFrame:
    """A-15: (novel_id, id, holders, locations, states, first) of each object
    from its boundary fields and its facts; a fact goes by what its predicate
    speaks of, location before holder, and any other is a state predicate:value.

    boundary (novel_id, entity_type, entity_id, field, value, first), facts
    (novel_id, kind, subject_id, predicate, value, first).
    """
    said = norm_text(F.col("predicate"))
    at = said.contains("location") | said.contains("位置")
    held = said.contains("holder") | said.contains("持有")
    what = F.when(F.col("field") == "holderCharacterId", "holders").when(F.col("field") == "location", "locations").when(F.col("field") == "state", "states")
    a = boundary.where("entity_type = 'object'").select("novel_id", F.col("entity_id").alias("id"), what.alias("what"), F.nullif(F.col("value"), F.lit("")).alias("value"), "first")
    b = facts.where("kind = 'object'").select(
        "novel_id",
        F.col("subject_id").alias("id"),
        F.when(at, "locations").when(held, "holders").otherwise("states").alias("what"),
        F.when(at | held, F.col("value")).otherwise(F.concat("predicate", F.lit(":"), "value")).alias("value"),
        "first",
    )
    of = lambda w: F.array_sort(F.collect_set(F.when(F.col("what") == w, F.col("value")))).alias(w)
    return a.unionByName(b).groupBy("novel_id", "id").agg(of("holders"), of("locations"), of("states"), F.min("first").alias("first"))


def identity_candidates(characters: DataFrame, objects: DataFrame, threads: DataFrame) -> DataFrame:
    """F-02: (novel_id, entity, id, name, first, ord): characters, then objects,
    then threads, each in the order given.  characters (novel_id, ord, id, name,
    first), objects (novel_id, id, first), threads (novel_id, ord, id, summary,
    first); objects are in order of first paragraph."""
    o = objects.withColumn("ord", F.row_number().over(W.partitionBy("novel_id").orderBy("first", "id")))
    parts = [("char", 0, characters, "name"), ("object", 1, o, "id"), ("thread", 2, threads, "summary")]
    rows = [d.select("novel_id", F.lit(e).alias("entity"), F.lit(k).alias("_k"), F.col("ord").cast("long").alias("_o"), "id", F.col(n).alias("name"), F.col("first").cast("long").alias("first")) for e, k, d, n in parts]
    all_ = reduce(DataFrame.unionByName, rows)
    return all_.withColumn("ord", F.row_number().over(W.partitionBy("novel_id").orderBy("_k", "_o", "id"))).drop("_k", "_o")


def evidence_snippets(refs: DataFrame, paragraphs: DataFrame, most: int = SNIPPET_CHARS) -> DataFrame:
    """O-06, O-08: (novel_id, id, pos, start, end, snippet): the first, middle
    and last reference of an id with their numbered paragraphs, together at most
    ``most`` characters.  refs (novel_id, id, pos, start, end), paragraphs
    (novel_id, n, text)."""
    w = W.partitionBy("novel_id", "id")
    r = refs.withColumn("k", F.row_number().over(w.orderBy("pos")) - 1).withColumn("total", F.count("*").over(w))
    r = r.where((F.col("k") == 0) | (F.col("k") == F.floor((F.col("total") - 1) / 2)) | (F.col("k") == F.col("total") - 1)).select("novel_id", "id", "pos", "start", "end")
    line = F.concat(F.lit(PILCROW), F.col("n").cast("string"), F.lit(" "), "text")
    met = r.join(paragraphs, "novel_id").where("n between start and end").groupBy("novel_id", "id", "pos").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["t"]), "\n")
    whole = r.join(met, ["novel_id", "id", "pos"], "left").groupBy("novel_id", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", F.coalesce(text, F.lit("")).alias("t")))).alias("x"))
    # what the snippets before have left over
    left = lambda i: F.greatest(F.lit(most) - F.aggregate(F.slice(F.col("x"), 1, i), F.lit(0), lambda a, v: a + F.length(v["t"])), F.lit(0))
    cut = F.transform("x", lambda v, i: F.struct(v["pos"].alias("pos"), v["start"].alias("start"), v["end"].alias("end"), F.substring(v["t"], F.lit(1), left(i)).alias("snippet")))
    return whole.select("novel_id", "id", F.explode(cut).alias("v")).select("novel_id", "id", "v.*")


def candidate_pages(candidates: DataFrame, order: str = "ord", size: str = "size", most: int = PAGE, chars: int = PAGE_CHARS) -> DataFrame:
    """O-09, F-03: ``candidates`` with page, from 0 within a novel: blocks of
    ``most`` in order, and a block of over ``chars`` characters is halved until
    its parts fit."""
    from foliant.operators.paging import halved_blocks

    return halved_blocks(candidates, ["novel_id"], order, size, most, chars, "page")


def parse_plan(answers: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F-03: (plan, errors) of the answers (novel_id, page, raw) about candidates
    (novel_id, page, entity, id).

    plan: (novel_id, page, entity, grp, pos, member_id, name, decision).  errors:
    (novel_id, page, entity, rule, at) for answers that are no JSON, lists that
    are missing, groups without members, name or decision, and candidates that a
    plan has twice, lacks or doesn't know.
    """
    parsed = F.from_json(json_text(F.col("raw")), PLAN)
    got = staged(answers.select("novel_id", "page", parsed.alias("_a"), parse_json(F.col("raw")).isNotNull().alias("_ok")))
    # a page has few candidates; sizes that are guessed from files don't count as small here
    asked = candidates.select("novel_id", "page", "entity", "id").groupBy("novel_id", "page").agg(F.collect_list(F.struct("entity", "id")).alias("_c"))
    rows = got.join(asked.hint("merge"), ["novel_id", "page"], "left").withColumn("_c", F.coalesce("_c", F.array().cast(asked.schema["_c"].dataType)))
    errors = F.flatten(F.array(*(_plan_errors(e, *names) for e, names in PLAN_LISTS.items())))
    found = F.when(F.col("_ok"), errors).otherwise(F.array(_say("", "invalid_json", F.lit(""))))
    groups = [got.where("_ok").select("novel_id", "page", F.lit(e).alias("entity"), F.posexplode(F.col("_a")[key]).alias("g", "v")).select("novel_id", "page", "entity", "g", F.col("v.memberIds").alias("members"), F.col(f"v.{name}").alias("name"), F.col("v.decision").alias("decision")) for e, (key, name) in PLAN_LISTS.items()]
    plan = reduce(DataFrame.unionByName, groups).select("novel_id", "page", "entity", F.concat_ws("/", F.col("page").cast("string"), F.col("g").cast("string")).alias("grp"), F.posexplode("members").alias("pos", "member_id"), "name", "decision")
    return plan, rows.select("novel_id", "page", F.explode(found).alias("x")).select("novel_id", "page", "x.*")


def _say(entity: str, rule: str, at: Column) -> Column:
    return F.struct(F.lit(entity).alias("entity"), F.lit(rule).alias("rule"), at.cast("string").alias("at"))


def _without(some: Column, others: Column) -> Column:
    """The different ids of one list that another lacks; no id is null's equal."""
    none = F.when(F.exists(some, lambda x: x.isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_except(F.array_compact(some), others), none)


def _plan_errors(entity: str, key: str, name: str) -> Column:
    """What is wrong with one list of an answer _a about its page's candidates _c."""
    given = F.col("_a")[key]
    groups = F.coalesce(given, F.array().cast(_GROUP))
    members = F.flatten(F.transform(groups, lambda v: F.coalesce(v["memberIds"], F.array().cast("array<string>"))))
    ids = F.transform(F.filter("_c", lambda c: c["entity"] == entity), lambda c: c["id"].cast("string"))
    absent = given.isNull() if entity == "char" else given.isNull() & (F.size(ids) > 0)
    has_null = lambda c: F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
    of_group = {
        "members_empty": lambda v: (F.coalesce(F.size(v["memberIds"]), F.lit(0)) < 1) | has_null(v["memberIds"]),
        "name_empty": lambda v: F.coalesce(norm_text(v[name]) == "", F.lit(True)),
        "decision": lambda v: ~F.coalesce(v["decision"].isin("same", "uncertain"), F.lit(False)),
    }
    if entity == "char":
        of_group["aliases"] = lambda v: v["aliases"].isNull() | has_null(v["aliases"])
    found = [F.filter(F.array(F.when(absent, _say(entity, "missing_list", F.lit(key)))), lambda x: x.isNotNull())]
    for rule, bad in of_group.items():
        placed = F.transform(groups, lambda v, i: F.when(bad(v), _say(entity, rule, i)))  # noqa: B023
        found.append(F.filter(placed, lambda x: x.isNotNull()))
    again = let(F.array_sort(members), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & x.eqNullSafe(F.get(s, i - 1)))))
    missing = F.when(given.isNotNull(), _without(ids, members)).otherwise(F.array().cast("array<string>"))
    for rule, which in (("duplicate_member", again), ("unknown_member", _without(members, ids)), ("missing_member", F.array_distinct(missing))):
        found.append(F.transform(which, lambda x: _say(entity, rule, x)))  # noqa: B023
    return F.flatten(F.array(*found))


def assign(plan: DataFrame, candidates: DataFrame) -> DataFrame:
    """F-03, F-04, T11, T12: (novel_id, entity, canonical_id, name, decision,
    member_ids, first): the groups of all pages, numbered by earliest evidence,
    then by first member.  Uncertain groups fall apart into their members, which
    keep their own names; in a novel of more than one page every decision is
    uncertain, but what a page has joined stays joined."""
    rows = plan.join(candidates.select("novel_id", "entity", F.col("id").alias("member_id"), F.col("name").alias("_own"), "first"), ["novel_id", "entity", "member_id"])
    alone = F.col("decision") == "uncertain"
    rows = rows.withColumns({"_u": F.when(alone, F.concat("grp", F.lit("/"), "member_id")).otherwise(F.col("grp")), "name": F.when(alone, F.col("_own")).otherwise(F.col("name"))})
    by = rows.groupBy("novel_id", "entity", "_u").agg(
        F.min_by("name", "pos").alias("name"), F.min("decision").alias("decision"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "member_id"))), lambda x: x["member_id"]).alias("member_ids"), F.min("first").alias("first")
    )
    pages = plan.groupBy("novel_id").agg(F.count_distinct("page").alias("_pages"))
    n = F.row_number().over(W.partitionBy("novel_id", "entity").orderBy("first", F.col("member_ids")[0]))
    by = by.withColumn("canonical_id", F.format_string("%s_%04d", F.col("entity"), n)).join(pages, "novel_id")
    return by.select("novel_id", "entity", "canonical_id", "name", F.when(F.col("_pages") > 1, "uncertain").otherwise(F.col("decision")).alias("decision"), "member_ids", "first")


def identity_conflicts(plan: DataFrame) -> DataFrame:
    """F-04, T11, T12: (novel_id, id, members): one for each uncertain group of
    more than one member, and one for a novel of more than one page."""
    g = plan.where("decision = 'uncertain'").groupBy("novel_id", "entity", "page", "grp").agg(F.array_sort(F.collect_list("member_id")).alias("members")).where(F.size("members") > 1)
    kind = F.when(F.col("entity") == "char", "conflict_identity_").otherwise(F.concat(F.lit("conflict_"), "entity", F.lit("_identity_")))
    n = F.row_number().over(W.partitionBy("novel_id", "entity").orderBy("page", "grp"))
    rows = g.select("novel_id", F.concat(kind, F.format_string("%03d", n)).alias("id"), "members")
    paged = plan.groupBy("novel_id").agg(F.count_distinct("page").alias("p")).where("p > 1")
    return rows.unionByName(paged.select("novel_id", F.lit("conflict_identity_pagination_001").alias("id"), F.array().cast("array<string>").alias("members")))


def build_characters(members: DataFrame) -> DataFrame:
    """F-11, A-07, A-08: (canonical_id, name, aliases, description, status) from
    rows (canonical_id, name, aliases, description, decision, first): the name
    and description of the earliest evidence, all other names as aliases."""
    by = members.groupBy("canonical_id").agg(
        F.min_by("name", "first").alias("name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))))).alias("names"),
        F.min_by("description", F.when(F.length("description") > 0, F.col("first"))).alias("description"),
        F.when(F.bool_or(F.col("decision") == "uncertain"), "provisional").otherwise("confirmed").alias("status"),
    )
    return by.select("canonical_id", "name", F.filter("names", lambda x: x != F.col("name")).alias("aliases"), "description", "status")


def rewrite(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """F-12, J-02: ids replaced by their canonical ones; an unknown id stays.
    ``mapping``: (member_id, canonical_id), member_id unique."""
    for c in columns:
        m = mapping.select(F.col("member_id").alias("_m"), F.col("canonical_id").alias("_to"))
        rows = rows.join(m, F.col(c) == F.col("_m"), "left").withColumn(c, F.coalesce("_to", c)).drop("_m", "_to")
    return rows


def merge_scalars(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """A-09, A-14: (key, value, ambiguous): rows that fall on one key after the
    rewrite agree if their values do in normal form; empty values don't count."""
    v = F.nullif(F.col(value), F.lit(""))
    return rows.groupBy(*key).agg(F.min(v).alias(value), (F.count_distinct(norm_text(v)) > F.when(F.count_if(v.isNull()) > 0, 2).otherwise(1)).alias("ambiguous"))


def match_characters(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """F-07, P-08: (novel_id, ord, id, outcome) of characters arriving in order.

    Under a known id: conflict if the name differs or a name is also somebody
    else's, else same, and its names join.  Under a new id: provisional if a name
    is somebody else's, else new; either way it is known to those after it.
    Pronouns are nobody's name, but two characters called alike collide.  Both
    tables: (novel_id, ord, id, name, aliases); the state of a novel is a fold.
    """
    tidy = lambda c: norm_text(F.col(c))
    names = F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), norm_text), lambda x: (x != "") & ~x.isin(*PRONOUNS)))
    part = lambda d, new: d.select("novel_id", F.lit(new).alias("new"), F.col("ord").cast("long").alias("ord"), "id", tidy("name").alias("name"), names.alias("names"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        name_of: dict[str, str] = {}
        owners: dict[str, set[str]] = {}  # of a meaningful name
        called: dict[str, set[str]] = {}  # of a primary name
        out = []
        for r in pdf.sort_values(["new", "ord"]).itertuples(index=False):
            own = list(r.names)
            others = set().union(*(owners.get(n, set()) for n in own), called.get(r.name, set())) - {r.id}
            there = r.id in name_of
            if r.new:
                outcome = ("conflict" if others or name_of[r.id] != r.name else "same") if there else ("provisional" if others else "new")
                out.append((r.novel_id, r.ord, r.id, outcome))
                if outcome == "conflict":
                    continue
            if not there:
                name_of[r.id] = r.name
                called.setdefault(r.name, set()).add(r.id)
            for n in own:
                owners.setdefault(n, set()).add(r.id)
        return pd.DataFrame(out, columns=["novel_id", "ord", "id", "outcome"])

    kinds = dict(incoming.dtypes)
    return part(known, False).unionByName(part(incoming, True)).groupBy("novel_id").applyInPandas(fold, f"novel_id {kinds['novel_id']}, ord long, id {kinds['id']}, outcome string")


def merge_threads(state: DataFrame, opened: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F-09, T15: ((novel_id, id, summary, status), (novel_id, id, rule)) after a
    delta: opened threads that are new join as open, resolved ones close.  A
    thread opened again stays as it is, and is a conflict if its summary differs;
    so is closing one that isn't there.  state (novel_id, id, summary, status),
    opened (novel_id, ord, id, summary), resolved (novel_id, id)."""
    w = W.partitionBy("novel_id", "id").orderBy("_p", "ord")
    rows = state.select("novel_id", "id", "summary", "status", F.lit(0).alias("_p"), F.lit(0).cast("long").alias("ord")).unionByName(opened.select("novel_id", "id", "summary", F.lit("open").alias("status"), F.lit(1).alias("_p"), F.col("ord").cast("long").alias("ord")))
    rows = rows.withColumn("_first", F.first("summary").over(w)).withColumn("_k", F.row_number().over(w))
    done = resolved.select("novel_id", "id", F.lit(True).alias("_d")).distinct()
    after = rows.where("_k = 1").join(done, ["novel_id", "id"], "left").select("novel_id", "id", "summary", F.when(F.col("_d"), "resolved").otherwise(F.col("status")).alias("status"))
    other = rows.where((F.col("_k") > 1) & (norm_text(F.col("summary")) != norm_text(F.col("_first")))).select("novel_id", "id", F.lit("thread_differs").alias("rule"))
    gone = resolved.join(rows.select("novel_id", "id"), ["novel_id", "id"], "left_anti").select("novel_id", "id", F.lit("thread_missing").alias("rule"))
    return after, other.unionByName(gone)


def merge_conflicts(state: DataFrame, raised: DataFrame, closed: DataFrame, version: Column) -> DataFrame:
    """F-10: (novel_id, id, type, description, status) after a delta: raised
    conflicts get ids conflict_v<version>_<seq> in order, from 001; closed ones
    are resolved.  raised: (novel_id, ord, type, description)."""
    seq = F.row_number().over(W.partitionBy("novel_id").orderBy("ord"))
    new = raised.select("novel_id", F.format_string("conflict_v%d_%03d", version, seq).alias("id"), "type", "description", F.lit("open").alias("status"))
    done = closed.select("novel_id", "id", F.lit(True).alias("_d")).distinct()
    rows = state.select("novel_id", "id", "type", "description", "status").unionByName(new).join(done, ["novel_id", "id"], "left")
    return rows.withColumn("status", F.when(F.col("_d"), "resolved").otherwise(F.col("status"))).drop("_d")
