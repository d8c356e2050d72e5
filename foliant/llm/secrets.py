"""Operator 4: secret scans, DataFrame functions only.

Base patterns give spans of assignments, access keys and long hexadecimal runs.
The method adds spans of kind ``markov``: a run of at least 16 identifier
characters, of what is left of the text beside the base spans, whose likelihood
under a character Markov model of random strings exceeds that under one of
ordinary identifiers.  ``=`` ends a run (but for padding), so a key behind a long
plain name is judged by itself.  Both first-order models are
trained from labelled samples: RANDOMS strings made from digests (hexadecimal,
base64, base62 and upper-case alphabets) and the identifiers of about SAMPLE
documents, clear of base spans, with compounds of them in three cases.  Their ratio is one
table of an entry per character pair, a constant in the plan.

Spans come from ``split`` and ``regexp_extract_all`` of the same pattern: the
texts between the matches and the matches alternate, so lengths add up to code
point positions.  Running sums and maxima over a text's m matches are taken in
blocks of sqrt(m), and texts are put together from pieces, so long texts full of
matches stay cheap.  Everything is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import hash_sample, table

#: The base patterns, and the alphabet of identifier characters.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 8
RANDOMS = 8_000
SAMPLE = 2_000
MARGIN = 0.5
SMOOTH = 0.5


SPAN = "array<struct<start:int,kind:int,end:int>>"
FEW = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also for lambdas in ``body``."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, merge, zero: int = 0) -> Column:
    """array<int> of the running ``merge`` of an array<int>.  Blocks of sqrt(n)
    are folded, then their last results, then each block is merged with the
    result before it: no array is copied once for each entry."""

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(zero).cast("int").alias("last"), F.array().cast("array<int>").alias("all"))

        def step(acc: Column, x: Column) -> Column:
            new = merge(acc["last"], x)
            return F.struct(new.alias("last"), F.concat(acc["all"], F.array(new)).alias("all"))

        return F.aggregate(xs, start, step, lambda acc: acc["all"])

    def joined(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(zero).cast("int")), fold(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, at: F.transform(b, lambda x: merge(at, x))))

    def run(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return _let(width, lambda w: _let(F.transform(F.sequence(F.lit(1), F.size(v), w), lambda a: fold(F.slice(v, a, w))), joined))

    return _let(values, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct(start, kind, end)> of the matches; ``keep`` gives an array of
    booleans, which of an array of matches stay."""

    def made(p: Column) -> Column:
        found = p["found"]
        steps = F.zip_with(F.slice(p["between"], 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        stay = keep(found) if keep is not None else F.transform(found, lambda m: F.lit(True))
        parts = F.arrays_zip(_running(steps, lambda x, y: x + y).alias("end"), found.alias("match"), stay.alias("stay"))
        return F.transform(F.filter(parts, lambda x: x["stay"]), lambda x: F.struct((x["end"] - F.length(x["match"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")), made)


def _none() -> Column:
    return F.array().cast(SPAN)


def _stretches(spans: Column) -> Column:
    """array<struct(start, end)> of what sorted spans cover; spans that overlap
    are one stretch, spans that only touch are two."""

    def made(x: Column) -> Column:
        marks = F.zip_with(x["spans"], F.slice(F.concat(F.array(F.lit(0)), x["ends"]), 1, F.size(x["spans"])), lambda s, before: F.struct(s["start"].alias("start"), (s["start"] >= before).alias("new")))
        opens = F.filter(F.transform(marks, lambda m, i: F.struct(m["start"].alias("start"), m["new"].alias("new"), i.alias("i"))), lambda m: m["new"])
        last = lambda o, k: F.get(x["ends"], F.coalesce(F.get(o, k + 1)["i"], F.size(x["ends"])) - 1)
        return _let(opens, lambda o: F.transform(o, lambda m, k: F.struct(m["start"].alias("start"), last(o, k).alias("end"))))

    ends = lambda s: _running(F.transform(s, lambda v: v["end"]), lambda a, b: F.greatest(a, b))
    return _let(_let(spans, lambda s: F.struct(s.alias("spans"), ends(s).alias("ends"))), made)


def _replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with every stretch of the sorted ``spans`` replaced by ``by`` of
    its length.  Up to FEW pieces are cut out of the text, more out of the array
    of its characters."""

    def put(st: Column, cut, end: Column) -> Column:
        kept = F.transform(st, lambda x, k: F.concat(cut(F.when(k > 0, F.get(st, k - 1)["end"]).otherwise(0), x["start"]), by(x["end"] - x["start"])))
        return F.concat(F.array_join(kept, ""), cut(F.element_at(st, -1)["end"], end))

    def made(x: Column) -> Column:
        few = put(x["st"], lambda a, b: x["text"].substr(a + 1, b - a), F.length(x["text"]))
        many = _let(F.split(x["text"], ""), lambda c: put(x["st"], lambda a, b: F.array_join(F.slice(c, a + 1, b - a), ""), F.size(c)))
        return F.when(F.size(x["st"]) == 0, x["text"]).when(F.size(x["st"]) <= FEW, few).otherwise(many)

    return _let(F.struct(text.alias("text"), _stretches(spans).alias("st")), made)


def scan_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns _scan0, _scan1, _scan2 of base spans."""
    t = F.col(text)
    long_ = lambda _: F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_VALUE)
    return docs.withColumns(
        {
            "_scan0": F.when((t.contains("=") | t.contains(":")) & t.rlike(ASSIGN), _spans(t, ASSIGN, 0, long_)).otherwise(_none()),
            "_scan1": F.when(t.contains("AKIA") & t.rlike(ACCESS), _spans(t, ACCESS, 1)).otherwise(_none()),
            "_scan2": F.when(t.rlike(HEX), _spans(t, HEX, 2)).otherwise(_none()),
        }
    )


def labelled(docs: DataFrame, text: str = "text", sample: int = SAMPLE, randoms: int = RANDOMS) -> DataFrame:
    """(random boolean, token string): the training samples."""
    spark = docs.sparkSession
    few = hash_sample(docs.where(F.col(text).isNotNull()).select("doc_id", text), sample, "doc_id")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = few.select(F.regexp_extract_all(bare, F.lit("[A-Za-z0-9+/_=-]+"), F.lit(0)).alias("w"))
    marks = F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit(""))
    pairs = F.transform("w", lambda w, i: F.concat(w, marks[i % 4], F.initcap(F.coalesce(F.get("w", i + 1), F.lit("")))))
    paths = F.transform("w", lambda w, i: F.lower(F.concat(w, marks[i % 4], F.coalesce(F.get("w", i + 1), F.lit("")))))
    ordinary = words.select(F.explode(F.concat("w", pairs, paths, F.transform(paths, F.upper))).alias("token")).select(F.lit(False).alias("random"), "token")
    code = F.base64(F.unhex(F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)))
    forms = F.array(
        F.substring(F.sha2(F.concat(F.lit("hex"), F.col("id").cast("string")), 256), 1, 40),
        F.translate(code, "=", ""),
        F.translate(code, "+/=", "aZ"),
        F.upper(F.translate(code, "+/=", "27")),
    )
    made = spark.range(randoms).select(F.lit(True).alias("random"), forms[(F.col("id") % 4).cast("int")].alias("token"))
    return ordinary.union(made)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios, random to ordinary, of each pair of characters of
    ALPHABET in row order.  At most 2 * len(ALPHABET)^2 counts reach the driver."""
    n = len(ALPHABET)
    chars = F.split("token", "")
    two = F.zip_with(F.slice(chars, 1, F.length("token") - 1), F.slice(chars, 2, F.length("token") - 1), lambda a, b: F.concat(a, b))
    pairs = samples.where(F.length("token") > 1).select("random", F.explode(two).alias("p"))
    got = {(r["random"], r["p"]): r["c"] for r in pairs.groupBy("random", "p").agg(F.count("*").alias("c")).collect()}
    out = []
    for a in ALPHABET:
        total = [sum(got.get((k, a + b), 0) for b in ALPHABET) for k in (False, True)]
        for b in ALPHABET:
            p = [(got.get((k, a + b), 0) + SMOOTH) / (total[k] + SMOOTH * n) for k in (False, True)]
            out.append(math.log(p[1] / p[0]))
    return out


def _ratio(token: Column, table_: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    n = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: F.get(table_, a * n + b))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
    return total / (F.length(token) - 1)


def scan(docs: DataFrame, ratios: list[float], text: str = "text", margin: float = MARGIN, out: str = "spans") -> DataFrame:
    """``docs`` with the column ``out``: array of (start, kind, end) by start,
    then kind; positions in code points, kind an index into KINDS.

    A null or empty text has no spans; repeated rows stay; the columns of
    ``docs`` stay, ``out`` replaces one of its own name.
    """
    table_ = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    t = F.col(text)
    base = scan_base(docs, text).withColumn("_scan", F.concat("_scan0", "_scan1", "_scan2")).drop("_scan0", "_scan1", "_scan2")
    clear = F.when(F.size("_scan") > 0, _replaced(t, F.array_sort("_scan"), lambda n: F.repeat(F.lit(" "), n))).otherwise(t)
    odd = lambda found: F.transform(found, lambda m: _ratio(m, table_) > margin)
    runs = _let(clear, lambda c: F.when(c.rlike(RUN), _spans(c, RUN, 3, odd)).otherwise(_none()))
    return base.withColumn(out, F.array_sort(F.concat("_scan", runs))).drop("_scan")


def join_spans(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, ratios: list[float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, the number of spans of each base kind, the
    digest of the base spans and all spans as text."""
    spans = scan(docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")), ratios)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        *keep,
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(join_spans(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        join_spans(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, ratios: list[float], mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``, overlapping
    spans by one; null stays null."""
    columns = docs.columns
    found = scan(docs, ratios, out="_spans")
    done = _replaced(F.col("text"), F.col("_spans"), lambda _: F.lit(mask))
    return found.withColumn("text", F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))).select(*columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return report(docs, train(labelled(docs)))
