"""Heading evidence and chapter structure (P-02, P-03, H-01 .. H-07, H-09, H-10,
H-13 .. H-15, H-17); what is made of answers is in ``structure``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from foliant.functions.text import SPACES, WS, numbered_cost, numbered_size, padded_id, solid_chars, trim
from foliant.operators.batches import small_batches
from foliant.operators.segment import OPENING, WHOLE
from foliant.operators.runs import Runs
from foliant.operators.sequences import even_sample

#: Number characters, the heading patterns, and the bits of the signals.
HAN_NUMBER = "零〇一二三四五六七八九十百千万两壹貳叁肆伍陸柒捌玖拾佰仟萬廿卅卌"
ENGLISH_NUMBER = rf"(?:\d+|[ivxlcdm]+|[a-z]+(?:(?:-|{WS})[a-z]+){{0,3}})"
SPECIAL = rf"(?iu)^(?:序章|序言|前言|楔子|引子|尾声|後記|后记|番外|prologue|epilogue|preface|foreword|afterword)(?:$|(?:{WS}|[：:]).*)"
HAN_VOLUME = rf"^(?:第[{HAN_NUMBER}\d]+卷|卷[{HAN_NUMBER}\d]+)"
HAN_CHAPTER = rf"^第[{HAN_NUMBER}\d]+(?:章|回|篇|部)"
HAN_SECTION = rf"^第[{HAN_NUMBER}\d]+节"
HAN_NUMBERED = rf"^[{HAN_NUMBER}]{{1,8}}[、.]\x{{200b}}*\S"
ARABIC_NUMBERED = rf"^\d{{1,4}}[.．、]{WS}*\S"
ENGLISH_VOLUME = rf"(?i)^(?:part|book|volume){WS}+{ENGLISH_NUMBER}\b"
ENGLISH_CHAPTER = rf"(?i)^chapter{WS}+{ENGLISH_NUMBER}\b"
ENGLISH_SECTION = rf"(?i)^section{WS}+{ENGLISH_NUMBER}\b"
SIGNALS = ("explicit_volume", "explicit_chapter", "explicit_section", "markdown", "bracketed", "special_heading", "numbered_short_line", "repeated_later", "likely_toc")
STRONG_CAP, WEAK_CAP = 5_000, 1_200
MAX_HEADING = 160
LONGEST = 4 * MAX_HEADING + 32
ROLES = ("front_matter", "volume", "chapter", "section", "back_matter", "toc")


@F.pandas_udf(StringType())
def nfkc(col: pd.Series) -> pd.Series:
    """Compatibility normalisation has no built-in."""
    return col.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


#: Marked so that no filter is computed by a second run of it.
nfkc = nfkc.asNondeterministic()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used:
    column aliases are inlined when a filter is pushed through a projection."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unwrap(text: Column) -> Column:
    """X-13: struct(display, markdown, bracketed) of a normalised text."""
    pair = rf"^[【\[]{WS}*([^】\]]+){WS}*[】\]]{WS}*(.*)$"

    def shown(markdown: Column, t: Column) -> Column:
        return let(
            t.rlike(pair),
            lambda b: F.struct(
                F.regexp_replace(F.when(b, trim(F.regexp_replace(t, pair, "$1 $2"))).otherwise(t), f"{WS}+", " ").alias("display"),
                markdown.alias("markdown"),
                b.alias("bracketed"),
            ),
        )

    def bare(t: Column, markdown: Column) -> Column:
        cut = F.when(markdown, F.regexp_replace(t, rf"^#{{1,6}}{WS}*", "")).otherwise(t)
        return trim(F.regexp_replace(cut, r"^(?:\*\*|__)(.+)(?:\*\*|__)$", "$1"))

    return let(text, lambda t: let(t.rlike(rf"^#{{1,6}}(?:{WS}|$)"), lambda m: let(bare(t, m), lambda u: shown(m, u))))


def _classified(form: Column) -> Column:
    """struct(level, normalized, signals, fits) of an unwrapped heading."""

    def kinds(shown: Column, compact: Column) -> Column:
        level = (
            F.when(compact.rlike(HAN_VOLUME) | shown.rlike(ENGLISH_VOLUME), "volume")
            .when(compact.rlike(HAN_CHAPTER) | shown.rlike(ENGLISH_CHAPTER), "chapter")
            .when(compact.rlike(HAN_SECTION) | shown.rlike(ENGLISH_SECTION), "section")
            .otherwise("unknown")
        )
        other = F.when(shown.rlike(SPECIAL), "special_heading").when(compact.rlike(HAN_NUMBERED) | shown.rlike(ARABIC_NUMBERED), "numbered_short_line")
        of = lambda v: F.when(v == "unknown", other).otherwise(F.concat(F.lit("explicit_"), v))
        signals = lambda v: F.array_compact(F.array(F.when(form["markdown"], "markdown"), F.when(form["bracketed"], "bracketed"), of(v)))
        return let(level, lambda v: let(signals(v), lambda x: F.struct(v.alias("level"), F.lower(compact).alias("normalized"), x.alias("signals"), ((F.size(x) > 0) & (F.length(compact) <= MAX_HEADING)).alias("fits"))))

    return let(form["display"], lambda shown: let(F.regexp_replace(shown, WS, ""), lambda compact: kinds(shown, compact)))


#: What a heading of ASCII characters starts with, whatever its form, and the starts
#: that normalisation may make one of these or a heading of other characters: of the
#: ASCII characters before the first other one, only the last can be changed by it, and
#: Latin letters with marks (C0 to FF) stay what they are and change none.
WORDS = ("part", "book", "volume", "chapter", "section", "prologue", "epilogue", "preface", "foreword", "afterword")
ASCII_START = rf"(?i)^(?:[#\[*_]|\d{{1,4}}\.|{'|'.join(WORDS)})"
OTHER_START = rf"^(?:\d{{0,4}}|(?i:{'|'.join(sorted({w[:k] for w in WORDS for k in range(1, len(w))}, reverse=True))}))[\x00-\x7f]?[^\x00-\x7f\xc0-\xff]"
HEAD = 12


def may_open(text: Column) -> Column:
    """Whether a text's first characters can be those of a heading."""
    head = F.substring(F.ltrim(text, F.lit(SPACES)), 1, HEAD)
    return head.rlike(ASCII_START) | head.rlike(OTHER_START)


def classify(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """P-02: the rows of ``paragraphs`` that may be headings, with normalized,
    level and signals.

    Normalisation joins at most four characters to one, so texts of over LONGEST,
    four times MAX_HEADING and some marks, can't qualify and are dropped first, as
    are texts that start like no heading.  Only texts with characters that aren't
    ASCII are normalised; the others cross to Python as nulls.  A generator gives one
    row to what fits and none to the rest, so nothing is computed a second time
    for a filter.
    """
    rows = paragraphs.where(may_open(F.col(text)) & (solid_chars(F.col(text)) <= LONGEST)).withColumn("_t", trim(F.col(text)))
    rows = rows.withColumn("_u", nfkc(F.when(F.col("_t").rlike(r"[^\x00-\x7f]"), F.col("_t"))))
    fits = F.filter(F.array(let(unwrap(F.coalesce("_u", "_t")), _classified)), lambda x: x["fits"])
    rows = rows.select(*paragraphs.columns, F.explode(fits).alias("_h"))
    return rows.select(*paragraphs.columns, "_h.normalized", "_h.level", "_h.signals")


def is_strong(signals: Column) -> Column:
    """P-03."""
    return F.exists(signals, lambda s: s != "numbered_short_line")


def counts(candidates: DataFrame) -> DataFrame:
    """H-01: (novel_id, strong, weak, total)."""
    return candidates.groupBy("novel_id").agg(F.count_if(is_strong(F.col("signals"))).alias("strong"), F.count_if(~is_strong(F.col("signals"))).alias("weak"), F.count("*").alias("total"))


def sample(candidates: DataFrame, strong: int = STRONG_CAP, weak: int = WEAK_CAP) -> DataFrame:
    """H-02: candidates over a cap are thinned evenly, each strength for itself;
    (novel_id, n, strong, k)."""
    rows = candidates.select("novel_id", "n", is_strong(F.col("signals")).alias("strong"))
    size = F.count("*").over(W.partitionBy("novel_id", "strong"))
    rows = rows.withColumn("_many", size > F.when(F.col("strong"), strong).otherwise(weak))
    few = rows.where("not _many").withColumn("k", (F.row_number().over(W.partitionBy("novel_id", "strong").orderBy("n")) - 1).cast("long")).select("novel_id", "n", "strong", "k")
    for s, cap in ((True, strong), (False, weak)):
        part = rows.where(F.col("_many") & (F.col("strong") == s)).select("novel_id", "n")
        few = few.unionByName(even_sample(part, "novel_id", "n", cap).withColumn("strong", F.lit(s)))
    return few


def with_context(paragraphs: DataFrame) -> DataFrame:
    """H-03, H-05: (novel_id, n, text, before, after, upto): before and after, the
    80-character heads of the neighbours, and upto, the running cost of all
    paragraphs.  Heads and numbers move, no texts but those short enough for a
    heading; the text of the others is null."""
    own, text = solid_chars(F.col("text")), F.col("text")
    slim = paragraphs.select("novel_id", "n", F.when(own <= LONGEST, text).alias("text"), F.substring(text, 1, 80).alias("_head"), own.alias("_own"))
    runs = Runs(slim, ["novel_id"], ["n"]).neighbours("_head", "before", "after").total("upto", F.col("_own"))
    near = {c: F.coalesce(c, F.lit("")) for c in ("before", "after")}
    return runs.table().withColumns(near).drop("_head", "_own")


@F.pandas_udf(ArrayType(LongType()))
def _totals(values: pd.Series, at: pd.Series) -> pd.Series:
    """The total of an array's values up to each of the positions ``at``."""
    return pd.Series([None if v is None else np.cumsum(np.asarray(v, np.int64))[np.asarray(i, np.int64)] for v, i in zip(values, at, strict=True)], dtype=object)


def context_of(novels: DataFrame, paras: str = "paras") -> DataFrame:
    """``with_context`` where a novel's paragraphs lie in one array: only those
    that may be headings become rows, no text moves, and totals are made of novels
    that have some."""
    small_batches(novels.sparkSession)
    at = F.array_compact(F.transform(paras, lambda x, i: F.when(may_open(x) & (solid_chars(x) <= LONGEST), i)))
    rows = novels.select("novel_id", F.col(paras).alias("_p"), at.alias("_at"))
    head = lambda i: F.coalesce(F.substring(F.get("_p", i), 1, 80), F.lit(""))
    row = lambda i: F.struct((i + 1).alias("n"), F.get("_p", i).alias("text"), head(i - 1).alias("before"), head(i + 1).alias("after"))
    own = F.when(F.size("_at") > 0, F.transform("_p", solid_chars))
    rows = rows.select("novel_id", F.transform("_at", row).alias("_h"), _totals(own, F.col("_at")).alias("_upto"))
    rows = rows.select("novel_id", F.explode(F.arrays_zip("_h", "_upto")).alias("_x"))
    return rows.select("novel_id", "_x._h.*", F.col("_x._upto").alias("upto"))


def gaps(candidates: DataFrame) -> DataFrame:
    """H-05: characters since the candidate before and until the next, from the
    running totals ``upto`` of all paragraphs."""
    w = W.partitionBy("novel_id").orderBy("n")
    own = solid_chars(F.col("text"))
    since = F.col("upto") - own - F.coalesce(F.lag("upto").over(w), F.lit(0))
    until = F.lead(F.col("upto") - own).over(w) - F.col("upto")
    return candidates.withColumns({"since": since, "until": until})


def duplicates(candidates: DataFrame) -> DataFrame:
    """H-04, H-06: dup_count, others (at most four positions of the same
    heading) and repeated_later, one row a candidate."""
    by = candidates.groupBy("novel_id", "normalized").agg(F.count("*").alias("dup_count"), F.max("n").alias("last"))
    k = F.row_number().over(W.partitionBy("novel_id", "normalized").orderBy("n"))
    heads = candidates.withColumn("_k", k).where("_k <= 3").groupBy("novel_id", "normalized").agg(F.array_sort(F.collect_list("n")).alias("heads"))
    rows = candidates.join(by, ["novel_id", "normalized"]).join(heads, ["novel_id", "normalized"])
    others = F.filter(F.array_sort(F.array_distinct(F.concat("heads", F.array("last")))), lambda x: x != F.col("n"))
    return rows.withColumns({"others": F.slice(others, 1, 4), "repeated_later": F.col("last") > F.col("n")}).drop("heads", "last")


def likely_toc(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """H-06: repeated later, in the first 15 % (20 at least) of the paragraphs
    and within 400 characters of another candidate; adds likely_toc."""
    early = F.col("n") <= F.greatest(F.lit(20), F.ceil(F.col("n_paragraphs") * 0.15))
    near = (F.coalesce("since", F.lit(1 << 40)) < 400) | (F.coalesce("until", F.lit(1 << 40)) < 400)
    return candidates.join(sizes, "novel_id").withColumn("likely_toc", F.col("repeated_later") & early & near)


def mask(signals: Column) -> Column:
    """H-07."""
    bits = F.create_map(*(F.lit(x) for i, s in enumerate(SIGNALS) for x in (s, 1 << i)))
    return F.aggregate(signals, F.lit(0), lambda a, s: a.bitwiseOR(bits[s]))


def parents(picks: DataFrame) -> DataFrame:
    """H-13: parent of each pick: the current volume of a chapter, the current
    chapter (else volume) of a section; a volume ends the chapter before it."""
    w = W.partitionBy("novel_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("n")), ignorenulls=True).over(w)
    rows = picks.withColumns({"_v": last("volume"), "_c": last("chapter")})
    chapter = F.when(F.col("_v").isNull() | (F.col("_c") > F.col("_v")), F.col("_c"))
    parent = F.when(F.col("role") == "chapter", F.col("_v")).when(F.col("role") == "section", F.coalesce(chapter, F.col("_v")))
    return rows.withColumn("parent", parent).drop("_v", "_c")


def boundaries(picks: DataFrame) -> DataFrame:
    """H-14: (novel_id, n, kind): volumes, chapters (sections where there is no
    chapter) and front and back matter bound; sections beside chapters hint."""
    some = F.max(F.col("role") == "chapter").over(W.partitionBy("novel_id"))
    rows = picks.where("role <> 'toc'").withColumn("_some", some)
    kind = F.when((F.col("role") == "section") & F.col("_some"), "hint").otherwise("boundary")
    return rows.select("novel_id", "n", kind.alias("kind"))


def materialize(bounds: DataFrame, paragraphs: DataFrame | None, size: DataFrame | None = None) -> DataFrame:
    """H-15: (novel_id, idx, id, title, start, end) of the chapters that
    ``bounds`` (novel_id, n, title) open; ``size``: (novel_id, one, last), the
    first and last paragraph, where they are at hand."""
    if size is None:
        size = paragraphs.groupBy("novel_id").agg(F.max("n").alias("last"), F.min("n").alias("one"))
    head = bounds.groupBy("novel_id").agg(F.min("n").alias("low"))
    lead = size.join(head, "novel_id", "left").where("low is null or low > one").select("novel_id", F.col("one").alias("n"), F.when(F.col("low").isNull(), WHOLE).otherwise(OPENING).alias("title"))
    w = W.partitionBy("novel_id").orderBy("n")
    rows = bounds.select("novel_id", "n", "title").unionByName(lead).join(size, "novel_id")
    k = F.row_number().over(w)
    return rows.select("novel_id", (k - 1).alias("idx"), padded_id("chapter_", k).alias("id"), "title", F.col("n").alias("start"), (F.coalesce(F.lead("n").over(w), F.col("last") + 1) - 1).alias("end"))


def cost_of_range(paragraphs: DataFrame, ranges: DataFrame) -> DataFrame:
    """J-05: numbered cost of inclusive ranges, by their ends' running totals."""
    costs = paragraphs.select("novel_id", "n", (numbered_cost(F.col("text"), F.col("n")) + 1).alias("own"))
    run = Runs(costs, ["novel_id"], ["n"]).total("upto", F.col("own")).table()
    got = ranges.join(run.select("novel_id", F.col("n").alias("start"), (F.col("upto") - F.col("own")).alias("a")), ["novel_id", "start"])
    got = got.join(run.select("novel_id", F.col("n").alias("end"), F.col("upto").alias("b")), ["novel_id", "end"])
    return got.withColumn("cost", F.col("b") - F.col("a") - 1).drop("a", "b")


def cost_of_chapters(chapters: DataFrame, lengths: DataFrame) -> DataFrame:
    """J-05 for ranges that don't overlap, from ``lengths`` (novel_id, lengths),
    one array a novel: ``chapters`` with cost."""
    cost = lambda x, i, r: (numbered_size(x, i + r["start"]) + 1).cast("long")
    part = lambda r: F.slice("lengths", r["start"].cast("int"), (r["end"] - r["start"] + 1).cast("int"))
    total = lambda r: F.aggregate(F.transform(part(r), lambda x, i: cost(x, i, r)), F.lit(-1).cast("long"), lambda a, x: a + x)
    by = chapters.groupBy("novel_id").agg(F.collect_list(F.struct(*(c for c in chapters.columns if c != "novel_id"))).alias("_r"))
    rows = by.join(lengths.select("novel_id", "lengths"), "novel_id")
    rows = rows.select("novel_id", F.explode(F.transform("_r", lambda r: F.struct(r.alias("r"), total(r).alias("cost")))).alias("_x"))
    return rows.select("novel_id", "_x.r.*", "_x.cost")


def evidence_pages(rows: DataFrame, budget: int = 300_000) -> DataFrame:
    """H-09: (novel_id, n, page): rows in order, pages filled up to ``budget``
    characters with one between rows; each row on one page."""
    from foliant.operators.segment import greedy_bins

    by = rows.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("n", "size"))).alias("x"))
    bins = greedy_bins(F.transform("x", lambda r: r["size"]), budget, 1)
    got = by.select("novel_id", F.explode(F.arrays_zip("x", bins.alias("page"))).alias("z"))
    return got.select("novel_id", F.col("z.x.n").alias("n"), F.col("z.page").alias("page"))


def input_mode(novels: DataFrame, short: int = 30_000) -> DataFrame:
    """H-10: full_text for short novels, candidate_evidence for the others;
    ``novels``: (novel_id, text)."""
    return novels.select("novel_id", F.when(solid_chars(F.col("text")) <= short, "full_text").otherwise("candidate_evidence").alias("mode"))


def over_limit(found: DataFrame, strong: int = STRONG_CAP, weak: int = WEAK_CAP) -> DataFrame:
    """H-17: (novel_id, fallback): more strong candidates than are kept mean the
    plain fallback rather than a silent cut."""
    return found.select("novel_id", ((F.col("strong") > strong) | (F.col("weak") > weak)).alias("fallback"))
