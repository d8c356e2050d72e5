"""From model answers about headings to chapters and chunks (H-08, H-09, H-11,
H-12, H-16 .. H-18, C-03, C-08 .. C-10).

Answers are rows (novel_id, page, raw): the text a model gave for one page of
heading evidence.  Every rule is a query over flat tables; a novel's verdict is
a grouped aggregate, so any number of novels is resolved at once.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import headings as H
from foliant.operators import segment as S
from foliant.sources.model import extract_json
from foliant.sources.stage import staged

#: Levels in evidence rows, what an answer may say, and the room that a page keeps for what stands around its rows.
LEVEL_CODES = {"volume": "v", "chapter": "c", "section": "s", "unknown": "u"}
DECISIONS = ("selected", "uncertain")
PAGE_CHARS, PAGE_RESERVE = 300_000, 4_096
ANSWER = "struct<headings:array<struct<headingParagraph:double,role:string,decision:string>>>"
ISSUE = "novel_id string, code string, severity string, n long"


class Structure(NamedTuple):
    """status (novel_id, status), headings (novel_id, n, title, role, parent),
    bounds (novel_id, n, kind), toc (novel_id, n), issues (novel_id, code,
    severity, n)."""

    status: DataFrame
    headings: DataFrame
    bounds: DataFrame
    toc: DataFrame
    issues: DataFrame


def evidence(candidates: DataFrame, context: bool) -> DataFrame:
    """H-08: (novel_id, n, row, size), one JSON array for each candidate: number,
    text, level code, signal mask, distances to its neighbours, the other places
    of the same heading and their number; with ``context`` the numbers and heads
    of the paragraphs before and after."""
    level = F.coalesce(F.create_map(*(F.lit(x) for p in LEVEL_CODES.items() for x in p))[F.col("level")], F.lit("u"))
    text = lambda c, n: F.to_json(F.struct(T.clip(F.col(c), n).alias("x")))
    quoted = lambda c, n: F.regexp_extract(text(c, n), r'(?s)^\{"x":(.*)\}$', 1)
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    parts = [number(F.col("n")), quoted("text", 160), F.concat(F.lit('"'), level, F.lit('"')), number(H.mask(F.col("signals"))), number(F.col("since")), number(F.col("until"))]
    parts += [F.concat(F.lit("["), F.array_join(F.transform("others", lambda x: x.cast("string")), ","), F.lit("]")), number(F.coalesce("dup_count", F.lit(0)))]
    if context:
        before, after = F.col("before") != "", F.col("after") != ""
        parts += [number(F.when(before, F.col("n") - 1)), F.when(before, quoted("before", 80)).otherwise('""'), number(F.when(after, F.col("n") + 1)), F.when(after, quoted("after", 80)).otherwise('""')]
    row = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return candidates.select("novel_id", "n", row.alias("row"), T.utf16_units(row).alias("size"))


def pages(candidates: DataFrame, budget: int = PAGE_CHARS, reserve: int = PAGE_RESERVE) -> DataFrame:
    """H-09: (novel_id, n, row, page): every candidate on exactly one page.

    Rows have their context where all of a novel's fit one page; else they are
    filled, without it, into pages of ``budget`` less ``reserve`` characters.
    """
    rich, bare = (evidence(candidates, c) for c in (True, False))
    whole = rich.groupBy("novel_id").agg((F.sum("size") + F.count("*") + 1).alias("total"))
    one = whole.where(F.col("total") <= budget - reserve).select("novel_id")
    few = rich.join(one, "novel_id", "left_semi").select("novel_id", "n", "row", F.lit(0).alias("page"))
    many = bare.join(one, "novel_id", "left_anti")
    return few.unionByName(many.join(H.evidence_pages(many, budget - reserve - 2), ["novel_id", "n"]).select("novel_id", "n", "row", "page"))


def parse(answers: DataFrame) -> DataFrame:
    """H-11: (novel_id, page, picks array<struct(n, role, decision)>): picks is
    null where the text holds no JSON object of that shape.  A number may be
    written 5.0, but not 5.5; roles and decisions are of the known ones."""
    got = answers.withColumn("_a", F.from_json(extract_json(F.col("raw")), ANSWER)["headings"])
    n = lambda x: x["headingParagraph"]
    fine = F.forall("_a", lambda x: F.coalesce((n(x) == F.floor(n(x))) & x["role"].isin(*H.ROLES) & x["decision"].isin(*DECISIONS), F.lit(False)))
    picks = F.transform("_a", lambda x: F.struct(n(x).cast("long").alias("n"), x["role"].alias("role"), x["decision"].alias("decision")))
    return got.select("novel_id", "page", F.when(F.coalesce(fine, F.lit(False)), picks).alias("picks"))


def _issue(rows: DataFrame, code: str, severity: str, n: Column | None = None) -> DataFrame:
    return rows.select("novel_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(None) if n is None else n).cast("long").alias("n"))


def resolve(answers: DataFrame, candidates: DataFrame, page_of: DataFrame | None = None, limited: DataFrame | None = None) -> Structure:
    """H-12, H-16, H-17: what the answers make of each novel.

    In this order the first of these ends in the plain fallback: more candidates
    than were kept (``limited``: novel_id), an answer that can't be read, a pick
    that isn't on its answer's page (``page_of``: novel_id, n, page), a heading
    picked twice, a pick that is no candidate.  Otherwise uncertain picks and
    front matter after the body began are left out with a warning each, picks of
    a table of contents are set apart, and a novel without any boundary falls
    back with a warning.  candidates: (novel_id, n, text).
    """
    parsed = staged(parse(answers))
    each = parsed.select("novel_id", "page", F.posexplode("picks").alias("i", "p")).select("novel_id", "page", "i", "p.*")
    first = W.partitionBy("novel_id", "n").orderBy("page", "i")
    known = candidates.select("novel_id", "n", F.col("text").alias("title"))
    rows = staged(each.withColumn("again", F.row_number().over(first) > 1).join(known.withColumn("known", F.lit(True)), ["novel_id", "n"], "left"))
    earliest = lambda df, code: _issue(df.groupBy("novel_id").agg(F.min_by("n", F.struct("page", "i")).alias("n")), code, "error", F.col("n"))
    fatal = [(0, _issue(limited, "candidate_limit_exceeded", "warning"))] if limited is not None else []
    fatal.append((1, _issue(parsed.where("picks is null").select("novel_id").distinct(), "invalid_model_output", "error")))
    if page_of is not None:
        fatal.append((2, earliest(each.join(page_of.select("novel_id", "n", "page"), ["novel_id", "n", "page"], "left_anti"), "unknown_candidate")))
    fatal += [(3, earliest(rows.where("again"), "duplicate_heading")), (4, earliest(rows.where("known is null"), "unknown_candidate"))]
    stops = reduce(DataFrame.unionByName, [d.withColumn("_o", F.lit(o)) for o, d in fatal])
    stops = staged(stops.groupBy("novel_id").agg(F.min_by(F.struct("code", "severity", "n"), "_o").alias("x")).select("novel_id", "x.*"))

    live = rows.join(stops, "novel_id", "left_anti")
    unsure = live.where("decision = 'uncertain'")
    sure = live.where("decision <> 'uncertain'")
    toc = sure.where("role = 'toc'").select("novel_id", "n")
    body = F.coalesce(F.max(F.col("role").isin("volume", "chapter", "section")).over(W.partitionBy("novel_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    picked = sure.where("role <> 'toc'").withColumn("late", (F.col("role") == "front_matter") & body)
    headings = H.parents(picked.where("not late")).select("novel_id", "n", "title", "role", "parent")
    bounds = H.boundaries(headings)
    bare = answers.select("novel_id").distinct().join(stops, "novel_id", "left_anti").join(bounds.where("kind = 'boundary'"), "novel_id", "left_anti")
    issues = reduce(
        DataFrame.unionByName,
        [stops, _issue(unsure, "uncertain_heading", "warning", F.col("n")), _issue(picked.where("late"), "broken_hierarchy", "warning", F.col("n")), _issue(bare, "no_usable_boundary", "warning")],
    )
    falls = F.max(F.col("code").isin("no_usable_boundary", "candidate_limit_exceeded") | (F.col("severity") == "error"))
    by = issues.groupBy("novel_id").agg(falls.alias("falls"))
    novels = answers.select("novel_id").unionByName(stops.select("novel_id")).distinct()
    status = F.when(F.col("falls"), "fallback").when(F.col("falls").isNotNull(), "partial").otherwise("resolved")
    return Structure(novels.join(by, "novel_id", "left").select("novel_id", status.alias("status")), headings, bounds, toc, issues)


def chapter_rows(structure: Structure, paragraphs: DataFrame | None, lengths: DataFrame | None = None) -> DataFrame:
    """H-15 with all columns: (novel_id, idx, id, title, kind, heading, start,
    end, char_count) of every novel of ``paragraphs``, or of ``lengths``
    (novel_id, lengths), one array a novel, where they are at hand.  What lies
    before the first boundary is front matter; a novel that falls back is one
    chapter."""
    bounds = structure.bounds.where("kind = 'boundary'").select("novel_id", "n").join(structure.headings, ["novel_id", "n"]).join(structure.status.where("status <> 'fallback'"), "novel_id", "left_semi")
    size = None if lengths is None else lengths.where(F.size("lengths") > 0).select("novel_id", F.lit(1).alias("one"), F.size("lengths").alias("last"))
    rows = H.materialize(bounds.select("novel_id", "n", "title"), paragraphs, size)
    rows = rows.join(bounds.select("novel_id", F.col("n").alias("start"), F.col("n").alias("heading"), "role"), ["novel_id", "start"], "left")
    kind = F.coalesce("role", F.when(F.col("title") == S.OPENING, "front_matter").otherwise("fallback"))
    if lengths is None:
        costed = rows.join(H.cost_of_range(paragraphs, rows.select("novel_id", "start", "end")), ["novel_id", "start", "end"])
    else:
        costed = H.cost_of_chapters(rows, lengths)
    return costed.select("novel_id", "idx", "id", "title", kind.alias("kind"), "heading", "start", "end", F.col("cost").alias("char_count"))


def prepare(novels: DataFrame, target: int = S.TARGET, overlap: int = S.OVERLAP, novel_id: str = "novel_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """C-03: ((novel_id, paras), (novel_id, verdict)): the paragraphs of the
    texts within the limits, too long ones cut, and what is wrong with the
    others."""
    rows = novels.select(F.col(novel_id).alias("novel_id"), F.col(text).alias("text")).withColumn("verdict", S.input_guard(F.coalesce("text", F.lit(""))))
    fine = rows.where("verdict = 'ok'").select("novel_id", T.lines(F.coalesce("text", F.lit(""))).alias("paras"))
    return S.split_oversized(fine, target, overlap), rows.where("verdict <> 'ok'").select("novel_id", "verdict")


def chapter_errors(chapters: DataFrame, paragraphs: DataFrame, target: int = S.TARGET) -> DataFrame:
    """C-08: (novel_id, rule, at) for everything that is wrong with a table of
    chapters (novel_id, idx, id, start, end, char_count) over paragraphs
    (novel_id, n, text): chapters without text, text without chapters, numbers
    that don't run from 1, paragraphs over the target, ids used twice, ends that
    are no paragraph, ranges that don't follow each other, are reversed or end
    after the text, wrong sizes, an end that isn't covered."""
    c = chapters.select("novel_id", "idx", "id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "char_count")
    size = paragraphs.groupBy("novel_id").agg(F.min("n").alias("one"), F.max("n").alias("last"))
    say = lambda df, rule, at: df.select("novel_id", F.lit(rule).alias("rule"), at.cast("string").alias("at"))
    novels = c.select("novel_id").distinct()
    p = W.partitionBy("novel_id").orderBy("n")
    order = paragraphs.withColumn("k", F.row_number().over(p))
    w = W.partitionBy("novel_id").orderBy("idx")
    run = c.join(size, "novel_id").withColumn("want", F.coalesce(F.lag("end").over(w) + 1, F.col("one").cast("double")))
    known = paragraphs.select("novel_id", F.col("n").cast("double").alias("p")).distinct()
    ends = c.join(size.select("novel_id"), "novel_id", "left_semi").select("novel_id", "id", F.explode(F.array("start", "end")).alias("p"))
    costs = H.cost_of_range(paragraphs, c.select("novel_id", "id", "idx", "char_count", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    last = run.groupBy("novel_id").agg(F.max_by("end", "idx").alias("end"), F.first("last").alias("last"))
    return reduce(
        DataFrame.union,
        [
            say(novels.join(size, "novel_id", "left_anti"), "chapters_without_text", F.lit("")),
            say(size.join(novels, "novel_id", "left_anti"), "no_chapters", F.lit("")),
            say(order.where("n <> k"), "paragraph_order", F.col("n")),
            say(paragraphs.where(T.numbered_cost(F.col("text"), F.col("n")) > target), "paragraph_budget", F.col("n")),
            say(c.groupBy("novel_id", "id").agg(F.count("*").alias("k")).where("k > 1"), "duplicate_id", F.col("id")),
            say(ends.join(known, ["novel_id", "p"], "left_anti").select("novel_id", "id").distinct(), "unknown_end", F.col("id")),
            say(run.where("start <> want"), "gap", F.col("id")),
            say(run.where("end < start"), "reversed", F.col("id")),
            say(run.where("end > last"), "beyond_end", F.col("id")),
            say(costs.where("char_count <> cost"), "char_count", F.col("id")),
            say(last.where("end <> last"), "not_covered", F.lit("")),
        ],
    )


def split_hints(hints: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C-10: ((novel_id, hints), (novel_id, rule, at)): the distinct hints of a
    novel in order, and those that are no paragraph."""
    h = hints.select("novel_id", F.col("n").cast("double").alias("n")).distinct()
    known = paragraphs.select("novel_id", F.col("n").cast("double").alias("n")).distinct()
    bad = h.join(known, ["novel_id", "n"], "left_anti").select("novel_id", F.lit("unknown_hint").alias("rule"), F.col("n").cast("string").alias("at"))
    good = h.join(known, ["novel_id", "n"], "left_semi").groupBy("novel_id").agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("hints"))
    return good, bad


def chunk_rows(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """C-09: ``chunks`` with id, chapter_ids, chapter_ranges (the chapters'
    ranges clipped to the core), and context_start and context_end."""
    c = chapters.select("novel_id", F.col("idx").alias("_k"), F.col("id").alias("chapter_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = chunks.select("novel_id", "idx", "start", "end").join(c, "novel_id").where("_s <= end and _e >= start")
    one = F.struct("_k", "chapter_id", F.greatest("_s", "start").cast("int").alias("start"), F.least("_e", "end").cast("int").alias("end"))
    by = met.groupBy("novel_id", "idx").agg(F.array_sort(F.collect_list(one)).alias("x"))
    ranges = F.transform("x", lambda r: F.struct(r["chapter_id"].alias("chapter_id"), r["start"].alias("start"), r["end"].alias("end")))
    made = chunks.join(by, ["novel_id", "idx"], "left")
    return made.withColumns(
        {
            "id": T.padded_id("chunk_", F.col("idx") + 1),
            "chapter_ids": F.transform("x", lambda r: r["chapter_id"]),
            "chapter_ranges": ranges,
            "context_start": F.coalesce("before", "start"),
            "context_end": F.coalesce("after", "end"),
        }
    ).drop("x")


def chapter_first(novels: DataFrame, answer, target: int = S.TARGET, overlap: int = S.OVERLAP) -> dict[str, DataFrame]:
    """H-18: novels (novel_id, text) to chapters and chunks on one numbering of
    paragraphs.  ``answer`` gives answers (novel_id, page, raw) to evidence
    (novel_id, n, row, page).  The result has arrays and paragraphs, candidates,
    structure (status and issues), chapters, chunks and rejected; the tables
    between the steps are written to the shared folder.

    A novel's texts stay in the array where they were made: headings are looked
    for there, and chapters and chunks are made of the paragraphs' lengths."""
    arrays, rejected = prepare(novels, target, overlap)
    arrays = staged(arrays.withColumn("lengths", F.transform("paras", lambda x: F.length(x))))
    lengths = arrays.select("novel_id", "lengths")
    paragraphs = arrays.select("novel_id", F.posexplode("paras").alias("i", "text")).select("novel_id", (F.col("i") + 1).alias("n"), "text")
    found = staged(H.duplicates(H.gaps(staged(H.classify(H.context_of(arrays))))))
    kept = staged(found.join(H.sample(found).select("novel_id", "n"), ["novel_id", "n"], "left_semi"))
    limited = H.over_limit(H.counts(found)).where("fallback").select("novel_id")
    shown = staged(pages(kept))
    made = resolve(staged(answer(shown)), kept, shown.select("novel_id", "n", "page"), limited)
    made = Structure(*(staged(t) for t in made))
    chapters = staged(chapter_rows(made, None, lengths))
    hints, _ = split_hints(made.bounds.where("kind = 'hint'").select("novel_id", "n"), kept)
    starts = chapters.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.col("start").cast("int"))).alias("starts"))
    ready = lengths.join(starts, "novel_id").join(hints, "novel_id", "left").withColumn("hints", F.coalesce("hints", F.array().cast("array<int>")))
    chunks = chunk_rows(staged(S.chunks(ready, target, overlap, starts="starts", hints="hints", lengths="lengths")), chapters)
    return {"arrays": arrays, "paragraphs": paragraphs, "candidates": kept, "status": made.status, "issues": made.issues, "chapters": chapters, "chunks": chunks, "rejected": rejected}
