"""Operator 8: quality rules with robust multivariate outliers.

The base rule looks at one document: too few words, or too many words in
repeated five-word windows.  The method adds a test of the whole vector of
transformed statistics against the documents of the same language and source:
the minimum-covariance-determinant estimate of mean and covariance, and the
squared Mahalanobis distance from it.  A language and source of under LEAST
documents is judged by the estimate of its language, a language of under LEAST
by that of all documents.

The estimate is that of the H share of a group's documents whose covariance has
the smallest determinant.  It is sought from four different robust scatters; a
concentration step keeps the share H of documents nearest to the present
estimate and re-estimates from them, which never raises the determinant, and
steps are made until no determinant falls any more or STEPS are done.  The start
that ends with the smallest determinant gives the group's estimate.

A step is two grouped aggregates by group and start, a distance quantile and
sums of products, so a group of any size is pre-aggregated map-side and only
moments move.  Estimates are short rows and are joined back by group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import durable, release, small_batches, table
from foliant.llm.textkit import Words, slices

MIN_WORDS = 10
REPEAT_SHARE = 20
H = 0.75
STEPS = 8
FALL = 1e-3
LEAST = 50
#: Quantiles of the chi-squared distribution with 5 degrees of freedom, at 0.5 and at one in 10^6 from the top.
CHI_MEDIAN, CHI_CUT = 4.351, 35.89
#: Standard deviations below these are taken as these, so that a statistic that hardly varies in a group doesn't reject on its own.
FLOORS = (0.5, 0.06, 0.05, 0.08, 0.08)
VECTOR = ("v_words", "v_length", "v_symbols", "v_lines", "v_repeats")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns of ``keep`` and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words of every whole text; a null text has none of any."""
    small_batches(docs.sparkSession)
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in slices(batch.columns[len(keep)]):
                w = Words(data, offs, lower=False)
                chars = np.concatenate([[0], np.cumsum(w.solid & ((data & 0xC0) != 0x80))])
                marks = np.concatenate([[0], np.cumsum(symbol[data])])
                out = [w.count, np.diff(chars[offs]), np.diff(marks[offs]), _dup_lines(w), _repeat_words(w)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), *(pa.array(x.astype(np.int64)) for x in out)], [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(task, f"{fields}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def _later(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each entry, whether its key came before in its group, in order."""
    order = np.lexsort((np.arange(len(key)), key, group))
    g, k = group[order], key[order]
    out = np.zeros(len(key), bool)
    out[order[1:]] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    return out


def _dup_lines(w: Words) -> np.ndarray:
    data, offs, n = w.data, w.offs, len(w.count)
    feed = np.flatnonzero(data == 10)
    # a line ends at each feed and at the end of its text
    ends = np.concatenate([feed, offs[1:]])
    row_of_end = np.concatenate([np.searchsorted(offs, feed, "right") - 1, np.arange(n)])
    order = np.lexsort((np.concatenate([np.zeros(len(feed)), np.ones(n)]), ends, row_of_end))
    end, row = ends[order], row_of_end[order]
    begin = np.zeros(len(end), np.int64)
    begin[1:] = end[:-1] + 1
    firsts = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    begin[firsts] = offs[row[firsts]]
    held = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, row = begin[held], end[held], row[held]
    again = _later(row, w.spans(begin, end)) if len(row) else np.zeros(0, bool)
    return np.bincount(row[again], minlength=n)


def _repeat_words(w: Words) -> np.ndarray:
    at, h = w.windows()
    n = len(w.count)
    if not len(at):
        return np.zeros(n, np.int64)
    row = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    inside = np.cumsum(cover)[:-1] > 0
    return np.bincount(w.rows()[inside], minlength=n)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_SHARE)


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with the transformed statistics, each near a normal one."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    made = (
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(n / 10, F.lit(1.0))),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return stats.withColumns(dict(zip(VECTOR, made, strict=True)))


#: Tables of so many groups are broadcast (four rows of some 400 bytes a group); larger ones are joined by shuffles that Spark splits where they are skewed.
FEW_GROUPS = 20_000
P = len(VECTOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def grouped(rows: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``own``, the number of the estimate that judges a row (null
    where there are under ``least`` rows in all), and ``gids``, the numbers of
    the estimates it contributes to: 3k for a language and source, 3k + 1 for a
    language, 2 for all.  Also the table of groups, to be released."""
    n = rows.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    groups = durable(n.withColumn("k", F.monotonically_increasing_id()))
    by_lang = groups.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n_lang"), F.min("n").alias("smallest"), F.min("k").alias("first"))
    all_ = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] >= least
    last = all_ and not by_lang.where(F.col("n_lang") < least).isEmpty()
    by_pair = F.when(F.col("n") >= least, F.col("k") * 3)
    by_name = F.when(F.col("n_lang") >= least, F.col("first") * 3 + 1)
    named = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.coalesce(by_pair, by_name, F.lit(2 if all_ else None).cast("long")).alias("own"),
        F.array_compact(F.array(by_pair, F.when(F.col("smallest") < least, by_name), F.lit(2 if last else None).cast("long"))).alias("gids"),
    )
    named = F.broadcast(named) if groups.count() <= FEW_GROUPS else named
    return rows.join(named, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source"), groups


def _moments(rows: DataFrame, values: list[Column], by: list[str], chosen: Column | None = None) -> DataFrame:
    """Number, sums and sums of products of ``values`` by group."""
    on = (lambda x: x) if chosen is None else (lambda x: F.when(chosen, x))
    sums = [F.sum(on(v)).alias(f"s{i}") for i, v in enumerate(values)] + [F.sum(on(values[i] * values[j])).alias(f"p{i}_{j}") for i, j in PAIRS]
    return rows.groupBy(*by).agg(F.sum(on(F.lit(1))).alias("m"), *sums)


def regular(c: np.ndarray) -> np.ndarray:
    """A covariance whose standard deviations are no less than FLOORS."""
    return c + np.diag(np.maximum(np.array(FLOORS) ** 2 - np.diag(c), 0) + 1e-9)


def _covariance(r: dict, p: int = P) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([r[f"s{i}"] for i in range(p)]) / r["m"]
    c = np.zeros((p, p))
    for i, j in PAIRS:
        c[i, j] = c[j, i] = r[f"p{i}_{j}"] / r["m"] - mean[i] * mean[j]
    return mean, c


def _hint(groups: DataFrame):
    """What marks a table of one row or a few a group for its joins."""
    return F.broadcast if groups.count() <= FEW_GROUPS else lambda df: df


ESTIMATE = "gid long, start int, mean array<double>, inv array<double>, det double"


def _row(gid: int, start: int, mean: np.ndarray, c: np.ndarray) -> tuple:
    c = regular(c)
    return gid, start, mean.tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])


def _invert(moments: DataFrame) -> DataFrame:
    """Mean, inverse covariance and log determinant from a group's moments."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([_row(r["gid"], r["start"], *_covariance(r)) for r in pdf.to_dict("records")], columns=["gid", "start", "mean", "inv", "det"])

    return moments.where("m > 0").mapInPandas(task, ESTIMATE)


def _starts(rows: DataFrame, hint) -> DataFrame:
    """Four estimates a group.  Means are medians.  Covariances have the spread
    between quartiles, and as correlations none, those of tanh z, of z / |z| and
    of the half nearest to the medians, z being the standardised statistics."""
    q = [F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, v in enumerate(VECTOR)]
    quart = rows.groupBy("gid").agg(*q)
    width = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(P)]
    quart = durable(quart.select("gid", F.array(*(F.col(f"q{i}")[1] for i in range(P))).alias("mid"), F.array(*width).alias("width")))
    z = [(F.col(v) - F.col("mid")[i]) / F.col("width")[i] for i, v in enumerate(VECTOR)]
    scored = rows.join(hint(quart), "gid").withColumns({f"z{i}": x for i, x in enumerate(z)})
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]))
    scored = scored.withColumn("far", norm)
    half = scored.groupBy("gid").agg(F.percentile_approx("far", 0.5, 1000).alias("half"))
    scored = scored.join(hint(half), "gid")
    forms = [(F.tanh(F.col(f"z{i}")), F.col(f"z{i}") / F.greatest("far", F.lit(1e-9)), F.when(F.col("far") <= F.col("half"), F.col(f"z{i}"))) for i in range(P)]
    long_ = scored.select("gid", F.explode(F.array(*(F.struct(F.lit(k + 1).alias("start"), *(forms[i][k].alias(f"z{i}") for i in range(P))) for k in range(3)))).alias("x")).select("gid", "x.*").where("z0 is not null")
    made = _moments(long_, [F.col(f"z{i}") for i in range(P)], ["gid", "start"]).join(quart, "gid")

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                mid, wide = np.array(r["mid"]), np.array(r["width"])
                _, c = _covariance(r)
                sd = np.sqrt(np.maximum(np.diag(c), 1e-12))
                out.append(_row(r["gid"], r["start"], mid, (c / np.outer(sd, sd)) * np.outer(wide, wide)))
                if r["start"] == 1:
                    out.append(_row(r["gid"], 0, mid, np.diag(wide**2)))
            yield pd.DataFrame(out, columns=["gid", "start", "mean", "inv", "det"])

    out = durable(made.mapInPandas(task, ESTIMATE))
    release(quart)
    return out


def _distance(rows: DataFrame, estimate: DataFrame, hint, key: str = "gid", how: str = "inner") -> DataFrame:
    got = rows.join(hint(estimate.withColumnRenamed("gid", "_gid")), F.col(key) == F.col("_gid"), how).drop("_gid")
    d = [F.col(VECTOR[i]) - F.col("mean")[i] for i in range(P)]
    terms = [d[i] * d[j] * F.col("inv")[i * P + j] * (1 if i == j else 2) for i, j in PAIRS]
    return got.withColumn("d2", reduce(lambda a, b: a + b, terms)).drop("mean", "inv", "det")


def estimates(rows: DataFrame, steps: int = STEPS, h: float = H) -> DataFrame:
    """(gid, mean, inv, det) of each number in ``gids``: the concentrated start of
    least determinant; quantiles are exact to a thousandth of a group."""
    rows = durable(rows.select(F.explode("gids").alias("gid"), *VECTOR))
    hint = _hint(rows.select("gid").distinct())
    now = _starts(rows, hint)
    for k in range(steps):
        far = _distance(rows, now, hint)
        cut = far.groupBy("gid", "start").agg(F.percentile_approx("d2", h, 1000).alias("cut"))
        near = far.join(hint(cut), ["gid", "start"])
        old, now = now, durable(_invert(_moments(near, [F.col(v) for v in VECTOR], ["gid", "start"], F.col("d2") <= F.col("cut"))))
        fell = now.alias("a").join(old.alias("b"), ["gid", "start"]).where(F.col("a.det") < F.col("b.det") - FALL)
        done = k > 0 and fell.isEmpty()
        release(old)
        if done:
            break
    best = now.groupBy("gid").agg(F.min_by(F.struct("mean", "inv", "det"), F.struct("det", "start")).alias("e")).select("gid", "e.*")
    # consistency: the median distance of a group becomes that of the chi-squared distribution
    mid = _distance(rows, best, hint).groupBy("gid").agg(F.percentile_approx("d2", 0.5, 1000).alias("mid"))
    scale = F.least(F.lit(1.0), F.lit(CHI_MEDIAN) / F.greatest(F.col("mid"), F.lit(1e-9)))
    out = durable(best.join(mid, "gid").select("gid", "mean", F.transform("inv", lambda x: x * scale).alias("inv"), "det"))
    release(now, rows)
    return out


def rules(docs: DataFrame, keep: tuple[str, ...] = (), least: int = LEAST) -> DataFrame:
    """Verdicts on ``docs`` (doc_id, text, lang, source).

    Returns doc_id, the statistics, base_failed, kept, distance (squared
    Mahalanobis distance, null only where the whole table has under ``least``
    documents past the base rule, which then decides alone) and the columns of
    ``keep``.  Null text has no words and fails the base rule; null lang or
    source is a value of its own; repeated rows each count; an empty table gives
    no rows; columns beyond those named are ignored.
    """
    stats = durable(statistics(docs, ("doc_id", "lang", "source", *keep)).withColumn("base_failed", base_failed()))
    rows, groups = grouped(vectors(stats), least)
    found = estimates(rows.where("not base_failed"))
    far = _distance(rows, found, _hint(found), "own", "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CHI_CUT)
    out = durable(far.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance")))
    release(stats, groups, found)
    return out


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and distance of every document."""
    return rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
