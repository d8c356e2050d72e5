"""Paragraphs, chapters and budgeted chunks with overlap (C-01 .. C-12).

Paragraphs stay in one array per novel as long as they come from one text, so
segmentation and packing are narrow: no shuffle, and a batch of novels at a time
goes through Arrow where the bins depend on what came before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.batches import small_batches
from foliant.operators.runs import Runs

TARGET, OVERLAP = 25_000, 800
MAX_CHARS, MAX_BYTES = 500_000, 10 * 1024 * 1024
#: Lines that open a chapter, and the titles of what comes before the first and of a text without any.
CHAPTER_LINE = rf"(?i)^(?:第[零〇一二三四五六七八九十百千万两\d]+[章回节卷部篇](?:$|(?:{T.WS}|[：:·、—\-]).*)|[零〇一二三四五六七八九十百千万两]{{1,8}}、{T.WS}*[^\s].*|(?:chapter|part){T.WS}+[\divxlcdm]+(?:$|(?:{T.WS}|[：:·、—\-]).*)|序章|序言|前言|楔子|尾声|后记|番外.*)$"
OPENING, WHOLE = "开篇", "正文"
#: The labels of a chunk's sections.
BEFORE = "【重叠上文：只用于理解衔接，不重复提取事实】"
CORE = "【核心文本：本次只对这个区间提取事实】"
AFTER = "【重叠下文：只用于理解衔接，不重复提取事实】"
SENTENCE_ENDS = "。！？!?；;"
#: Fixed value: what the number of a paragraph takes at most, whatever a novel holds.
NUMBER = 12

CHUNK = "array<struct<idx:int,start:int,end:int,core_chars:long,before:int,after:int,context_chars:long>>"


def check_budgets(target: int, overlap: int) -> None:
    """C-02."""
    if not (isinstance(target, int) and isinstance(overlap, int)) or target <= 0 or overlap < 0:
        raise ValueError("target must be a positive integer, overlap a non-negative one")


def paragraphs(novels: DataFrame, novel_id: str = "novel_id", text: str = "text") -> DataFrame:
    """X-05: (novel_id, n, text), numbered from 1."""
    got = novels.select(F.col(novel_id).alias("novel_id"), F.posexplode(T.lines(F.col(text))).alias("p", "text"))
    return got.select("novel_id", (F.col("p") + 1).alias("n"), "text")


def input_guard(text: Column) -> Column:
    """S-04: 'chars', 'bytes' or 'ok'."""
    return F.when((F.length(text) > MAX_CHARS) & (T.solid_chars(text) > MAX_CHARS), "chars").when(F.octet_length(text) > MAX_BYTES, "bytes").otherwise("ok")


def is_chapter(text: Column) -> Column:
    """P-01."""
    return (T.utf16_units(text) <= 80) & text.rlike(CHAPTER_LINE)


def chapters(numbered: DataFrame, heading: Column | None = None) -> DataFrame:
    """C-04: (novel_id, idx, id, title, start, end, char_count) from a table of
    paragraphs; ``heading`` says which of them open a chapter.  Costs and titles
    move, the texts stay where they are."""
    opens = is_chapter(F.col("text")) if heading is None else heading
    slim = numbered.select("novel_id", "n", opens.cast("int").alias("opens"), F.when(opens, F.col("text")).alias("title"), T.numbered_cost(F.col("text"), F.col("n")).alias("cost"))
    rows = Runs(slim, ["novel_id"], ["n"]).total("g", F.col("opens")).table()
    by = rows.groupBy("novel_id", "g").agg(F.min("n").alias("start"), F.max("n").alias("end"), (F.sum("cost") + F.count("*") - 1).alias("char_count"), F.min_by("title", "n").alias("first"))
    by = by.withColumn("some", F.max(F.col("g") > 0).over(W.partitionBy("novel_id")))
    title = F.when(F.col("g") > 0, F.col("first")).when(F.col("some"), OPENING).otherwise(WHOLE)
    idx = F.row_number().over(W.partitionBy("novel_id").orderBy("g")) - 1
    return by.select("novel_id", idx.alias("idx"), T.padded_id("chapter_", idx + 1).alias("id"), title.alias("title"), "start", "end", "char_count")


def pack_units(costs: np.ndarray, starts: list[int], hints: list[int], target: int) -> list[tuple[int, int]]:
    """C-05, C-06: inclusive index ranges of the cores.

    A chapter that fits is a unit; a longer one is cut at its hints, and a piece
    that still doesn't fit is filled paragraph by paragraph.  Units are then
    joined in order while they fit, one character apart.
    """
    total = np.concatenate([[0], np.cumsum(np.asarray(costs, np.int64) + 1)])

    def size(a: int, b: int) -> int:
        return int(total[b + 1] - total[a]) - 1

    def fill(a: int, b: int):
        while a <= b:
            # the last paragraph that still fits; one that is too long stands alone
            e = max(a, min(b, int(np.searchsorted(total, total[a] + target + 1, "right")) - 2))
            yield a, e
            a = e + 1

    units = []
    for a, b in zip(starts, [*(s - 1 for s in starts[1:]), len(costs) - 1], strict=True):
        if size(a, b) <= target:
            units.append((a, b))
            continue
        cuts = [a, *sorted({h for h in hints if a < h <= b})]
        for x, y in zip(cuts, [*(c - 1 for c in cuts[1:]), b], strict=True):
            units += [(x, y)] if size(x, y) <= target else fill(x, y)
    out: list[tuple[int, int]] = []
    for a, b in units:
        if out and size(out[-1][0], b) <= target:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def overlaps(costs: np.ndarray, a: int, b: int, overlap: int, total: np.ndarray) -> tuple[int, int]:
    """C-07: first paragraph before and last after a core that fit in the
    overlap budget; the core's own ends where none does."""
    lo = bisect_left(total, total[a] - 1 - overlap, 0, a)
    hi = bisect_right(total, total[b + 1] + 1 + overlap, b + 1) - 2
    return min(lo, a), max(hi, b)


def chunks(novels: DataFrame, target: int = TARGET, overlap: int = OVERLAP, novel_id: str = "novel_id", paras: str = "paras", starts: str | None = None, hints: str | None = None, keep: tuple[str, ...] = (), lengths: str | None = None) -> DataFrame:
    """C-09: (novel_id, idx, start, end, core_chars, before, after,
    context_chars) and the columns of ``keep``, one row a chunk; before and after
    are null without overlap.

    ``paras`` is the array of paragraph texts, or ``lengths`` that of their
    lengths; ``starts`` and ``hints`` arrays of paragraph numbers that open
    chapters and sections.
    """
    check_budgets(target, overlap)

    @F.pandas_udf(CHUNK)
    def pack(costs: pd.Series, first: pd.Series, inner: pd.Series) -> pd.Series:
        out = []
        for c, s, h in zip(costs, first, inner, strict=True):
            rows = []
            if c is not None and len(c):
                total = np.concatenate([[0], np.cumsum(np.asarray(c, np.int64) + 1)])
                at = sorted({1, *(int(x) for x in (s if s is not None else []))})
                for k, (a, b) in enumerate(pack_units(c, [x - 1 for x in at], [int(x) - 1 for x in (h if h is not None else [])], target)):
                    lo, hi = overlaps(c, a, b, overlap, total)
                    rows.append(
                        {"idx": k, "start": a + 1, "end": b + 1, "core_chars": int(total[b + 1] - total[a]) - 1, "before": lo + 1 if lo < a else None, "after": hi + 1 if hi > b else None, "context_chars": int(total[hi + 1] - total[lo]) - 1}
                    )
            out.append(rows)
        return pd.Series(out)

    costs = F.transform(F.col(lengths), lambda x, i: T.numbered_size(x, i + 1)) if lengths else F.transform(F.col(paras), lambda x, i: T.numbered_cost(x, i + 1))
    none = F.array().cast("array<int>")
    got = novels.select(F.col(novel_id).alias("novel_id"), *keep, F.explode(pack(costs, F.col(starts) if starts else none, F.col(hints) if hints else none)).alias("c"))
    return got.select("novel_id", *keep, "c.*")


def coverage_violations(chunked: DataFrame, counts: DataFrame, target: int) -> DataFrame:
    """C-08, C-12: rows (novel_id, rule, n) for cores that don't follow each
    other, start at 1, end at the last paragraph, or keep the budget."""
    w = W.partitionBy("novel_id").orderBy("idx")
    rows = chunked.withColumn("gap", F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0)) + 1)
    bad = rows.groupBy("novel_id").agg(
        F.count_if("gap").alias("gap"), F.count_if((F.col("core_chars") > target) & (F.col("end") > F.col("start"))).alias("budget"), F.max("end").alias("end")
    )
    bad = bad.join(counts, "novel_id").withColumn("cover", (F.col("end") != F.col("n_paragraphs")).cast("long"))
    return bad.select("novel_id", F.explode(F.create_map(F.lit("gap"), "gap", F.lit("budget"), "budget", F.lit("cover"), "cover")).alias("rule", "n")).where("n > 0")


def numbered_text(paras: Column, start: Column, end: Column) -> Column:
    """X-06, X-07: paragraphs start..end with their numbers, one a line."""
    part = F.slice(paras, start, end - start + 1)
    return F.array_join(F.transform(part, lambda x, i: F.concat(F.lit(T.PILCROW), (i + start).cast("string"), F.lit(" "), x)), "\n")


def render_chunk(paras: Column, c: dict[str, Column]) -> Column:
    """C-11, R-02: the chunk's labelled sections."""
    before = F.when(c["before"].isNotNull(), F.concat(F.lit(BEFORE + "\n"), numbered_text(paras, c["before"], c["start"] - 1)))
    core = F.concat(F.lit(CORE + "\n"), numbered_text(paras, c["start"], c["end"]))
    after = F.when(c["after"].isNotNull(), F.concat(F.lit(AFTER + "\n"), numbered_text(paras, c["end"] + 1, c["after"])))
    return F.concat_ws("\n", before, core, after)


def split_by_budget(text: str, most: int) -> list[str]:
    """X-08: pieces of at most ``most`` code points that join to the text, cut
    after the last sentence end that fits, else hard."""
    if most <= 0:
        raise ValueError("the budget must be positive")
    out, at = [], 0
    while len(text) - at > most:
        cut = max((text.rfind(e, at, at + most) for e in SENTENCE_ENDS), default=-1)
        end = cut + 1 if cut >= at else at + most
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


def split_oversized(novels: DataFrame, target: int = TARGET, overlap: int = OVERLAP, novel_id: str = "novel_id", paras: str = "paras") -> DataFrame:
    """C-01: paragraphs that don't fit a core, or are long enough to be cut for
    overlap, are split by sentence; (novel_id, paras).  Only novels that may have
    one cross to Python: numbers leave a paragraph at most NUMBER characters less."""
    check_budgets(target, overlap)
    small_batches(novels.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(col: pd.Series) -> pd.Series:
        def one(texts) -> list[str] | None:
            if texts is None:
                return None
            texts = list(texts)
            room = len(str(max(1, len(texts), sum(map(len, texts))))) + 2
            core, over = target - room, overlap - room
            if core <= 0 and texts:
                raise ValueError("target is too small for numbered paragraphs")
            piece = min(core, over) if over > 0 else core
            return [p for t in texts for p in (split_by_budget(t, piece) if len(t) > core or (over > 0 and len(t) > over and len(t) >= 256) else [t])]

        return col.map(one)

    rows = novels.select(F.col(novel_id).alias("novel_id"), F.col(paras).alias("paras"))
    least = min(target - NUMBER, max(overlap - NUMBER, 255)) if overlap > 0 else target - NUMBER
    long = F.exists("paras", lambda x: F.length(x) > least)
    return rows.select("novel_id", F.coalesce(cut(F.when(long, F.col("paras"))), "paras", F.array().cast("array<string>")).alias("paras"))


def greedy_bins(sizes: Column, budget: int, joiner: int = 0) -> Column:
    """W-10, G-02: the bin of each entry of an array when bins are filled in
    order up to ``budget``; an entry that is too large stands alone."""

    @F.pandas_udf("array<int>")
    def bins(col: pd.Series) -> pd.Series:
        def one(v) -> list[int]:
            out, b, used = [], 0, None
            for x in v if v is not None else []:
                if used is not None and used + joiner + x > budget:
                    b, used = b + 1, None
                used = x if used is None else used + joiner + x
                out.append(b)
            return out

        return col.map(one)

    return bins(sizes)
