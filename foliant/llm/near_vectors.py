"""Operator 9: embedding near-dedup with a random-projection tree forest.

Equal vectors of one label become a class that is compared once.  Each of TREES
trees splits a label's classes recursively along random projections;
a class within SPILL of the split goes to both sides, so that near neighbours on
two sides of a split still meet.  The split lies near the median, where the
fewest classes go to both sides.

The trees grow in rounds, LEVELS levels at a time.  All classes of a label start
in one leaf.  A round takes every leaf of over LEAF classes, fits its further
splits on executors from at most about SAMPLE of the leaf's own classes, and
routes all its classes.  So leaves stay bounded at any number of vectors and of
labels, and no group holds more than a sample.  A split that would leave a side
nearly all classes isn't made: that leaf is final, whatever its size.

Classes that share a leaf are compared exactly, a leaf of over CAP classes in
blocks that are all compared with each other, so no task holds an unbounded leaf
and none is cut off.  A pair counts only in the first of the leaves it shares;
tasks return sums and one edge a class, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import components, durable, release, table

COSINE = 0.98
TREES = 6
LEAF = 256
SPILL = 0.015
SAMPLE = 10_000
LEVELS = 8
#: Levels a round where its splits are too many to broadcast: they then travel with the rows.
FEW_LEVELS = 4
SPREAD_BYTES = 64 << 20
#: Share of a node's classes that a side may get, spill included.
LARGEST = 0.8
#: Where a split may lie, nearest to the median first.
MIDDLE = (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65)
ROUNDS = 40
CAP = 2048
SEED = 5


def hashed(*x) -> np.ndarray:
    """A 63-bit mix of integers."""
    h = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for v in x:
            h = (h ^ np.uint64(int(v) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return int(h >> np.uint64(1))


def directions(leaf: int, tree: int, dim: int, levels: int) -> np.ndarray:
    """One unit vector a level, a function of the leaf and the tree."""
    d = np.random.default_rng([SEED, leaf, tree]).normal(size=(dim, levels))
    return d / np.linalg.norm(d, axis=0)


def sides(v: np.ndarray, cut: float, spill: float) -> tuple[np.ndarray, np.ndarray]:
    return v <= cut + spill, v > cut - spill


def split(leaf: int, tree: int, x: np.ndarray, share: float, target: int, spill: float, levels: int) -> np.ndarray:
    """Thresholds of a subtree of ``levels`` levels in heap order (node 1 is the
    root, 2n and 2n + 1 are the sides of n), NaN where a node isn't split.
    ``x`` is a sample of ``share`` of the leaf's unit vectors."""
    cuts = np.full(1 << levels, np.nan)
    p = x @ directions(leaf, tree, x.shape[1], levels)
    todo = [(1, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        if level == levels or len(rows) <= max(8, target * share):
            continue
        v = p[rows, level]
        # of some cuts around the median the one that doubles the fewest classes
        tries, order = np.quantile(v, MIDDLE), np.sort(v)
        doubled = np.searchsorted(order, tries + spill, "right") - np.searchsorted(order, tries - spill, "right")
        cut = float(tries[np.argmin(doubled)])
        both = sides(v, cut, spill)
        if max(b.sum() for b in both) > LARGEST * len(rows):
            continue
        cuts[node] = cut
        todo += [(2 * node + k, rows[b], level + 1) for k, b in enumerate(both)]
    return cuts


def route(leaf: int, cuts: np.ndarray, x: np.ndarray, spill: float, trees: int) -> list[np.ndarray]:
    """The new leaves of each row, sorted.  A leaf's number is odd if it is final
    and even if it was reached at the last level and may be split again."""
    cuts = cuts.reshape(trees, -1)
    levels = cuts.shape[1].bit_length() - 1
    rows, found = [], []
    for t in range(trees):
        p = x @ directions(leaf, t, x.shape[1], levels)
        todo = [(1, np.arange(len(x)), 0)]
        while todo:
            node, r, level = todo.pop()
            if level == levels or np.isnan(cuts[t, node]):
                if len(r):
                    rows.append(r)
                    found.append(np.full(len(r), hashed(leaf, t, node) & ~1 | (level < levels)))
                continue
            both = sides(p[r, level], cuts[t, node], spill)
            todo += [(2 * node + k, r[b], level + 1) for k, b in enumerate(both)]
    r, f = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((f, r))
    return np.split(f[order], np.cumsum(np.bincount(r, minlength=len(x)))[:-1])


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ROOT = 0


def _fitter(target: int, spill: float, levels: int, trees: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        at, x = int(pdf["leaf"].iloc[0]), unit(pdf["embedding"])
        cuts = [split(at, t, x, len(x) / int(pdf["n"].iloc[0]), target, spill, levels) for t in range(trees)]
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "leaf": [at], "cuts": [np.concatenate(cuts)]})

    return fit


def _mover(held, spill: float, levels: int, trees: int):
    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.full(trees << levels, np.nan)
        for pdf in frames:
            for (group, at), part in pdf.groupby(["group", "leaf"]):
                own = held.value.get((group, at)) if held else part["cuts"].iloc[0]
                new = route(int(at), none if own is None else np.asarray(own, np.float64), unit(part["embedding"]), spill, trees)
                yield pd.DataFrame({"cid": part["cid"], "leaf": at, "new": new})

    return move


def grown(classes: DataFrame, trees: int, leaf: int, spill: float, sample: int = SAMPLE, spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """``classes`` (cid, group, embedding) with the sorted leaves of each."""
    spark = classes.sparkSession
    now = durable(classes.withColumn("leaves", F.array(F.lit(ROOT).cast("long"))))
    for k in range(ROUNDS):
        again = F.explode(F.filter("leaves", lambda x: x % 2 == 0)).alias("leaf")
        open_ = now.select("group", again)
        big = durable(open_.groupBy("group", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf))
        n, n_trees = big.count(), trees if k == 0 else 1
        if not n:
            release(big)
            break
        spread = n * n_trees * 8 << LEVELS <= spread_bytes
        levels = LEVELS if spread else FEW_LEVELS
        rows = now.select("cid", "group", "embedding", again).join(big, ["group", "leaf"])

        few = rows.where(F.pmod(F.xxhash64("cid", "leaf"), F.lit(1 << 40)) < F.lit(float(sample << 40)) / F.col("n"))
        cuts = durable(few.groupBy("group", "leaf").applyInPandas(_fitter(leaf, spill, levels, n_trees), "group long, leaf long, cuts array<double>"))
        held = None
        if spread:
            held = spark.sparkContext.broadcast({(r["group"], r["leaf"]): np.array(r["cuts"]) for r in cuts.collect()})
            rows = rows.withColumn("cuts", F.lit(None).cast("array<double>"))
        else:
            rows = rows.join(cuts, ["group", "leaf"], "left")

        moved = rows.select("cid", "group", "leaf", "embedding", "cuts").mapInPandas(_mover(held, spill, levels, n_trees), "cid long, leaf long, new array<long>")
        moved = moved.groupBy("cid").agg(F.collect_list("leaf").alias("gone"), F.flatten(F.collect_list("new")).alias("new"))
        after = now.join(moved, "cid", "left").withColumn("leaves", F.when(F.col("new").isNull(), F.col("leaves")).otherwise(F.array_sort(F.array_union(F.array_except("leaves", "gone"), "new"))))
        old, now = now, durable(after.drop("gone", "new"))
        release(old, big, cuts)
    return now


def compare(pdf: pd.DataFrame, cosine: float = COSINE) -> pd.DataFrame:
    """Of the classes of a leaf, or of two of its blocks: cid, the vectors they
    link with in pairs first met here, and the least class they reach here."""
    leaf, i, j = int(pdf["leaf"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    cid, mult, own = pdf["cid"].to_numpy(), pdf["mult"].to_numpy(np.float64), pdf["own"].to_numpy()
    x = unit(pdf["embedding"])
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if i != j:
        near &= own[:, None] != own[None, :]
    lists = pdf["leaves"].tolist()
    before = {f: k for k, f in enumerate(sorted({f for v in lists for f in v if f < leaf}))}
    met = np.zeros((len(cid), len(before)), np.float32)
    for r, v in enumerate(lists):
        met[r, [before[f] for f in v if f < leaf]] = 1
    fresh = near & (met @ met.T == 0) if before else near
    low = cid.copy()
    big = np.iinfo(np.int64).max
    linked = np.flatnonzero(near.any(1))
    sub = near[np.ix_(linked, linked)]
    while len(linked):
        new = np.minimum(low[linked], np.where(sub, low[linked][None, :], big).min(1))
        if (new == low[linked]).all():
            break
        low[linked] = new
    return pd.DataFrame({"cid": cid[linked], "w": (fresh[linked] @ mult).astype(np.int64), "low": low[linked]})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, cap: int = CAP, sample: int = SAMPLE, spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Links of ``vectors`` (vec_id, embedding, label) of cosine at least
    ``cosine`` between equal, non-null labels.

    Returns vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable, itself included) and kept (vec_id equals
    component_id).  vec_id and label may be of any type that can be ordered.
    Vectors that are null, empty, zero or hold null or non-finite components, and
    those with a null label, link with nothing; vectors of different lengths
    don't link.  A vector without an id links like any other but names no
    component: it is kept only where no vector it reaches has an id.  Repeated
    rows count as vectors; an empty table gives no rows; other columns are
    ignored.
    """
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0) & F.col("label").isNotNull(), F.lit(False))
    keys = [F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")]
    rows = vectors.select("vec_id", "label", "embedding", fine.alias("fine"), keys[0].alias("h1"), keys[1].alias("h2"))
    found = rows.where("fine").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.any_value("embedding").alias("embedding"))
    # the number of a class is fixed by writing the table; vectors of one label and length are a group
    classes = durable(found.withColumn("cid", F.monotonically_increasing_id()).withColumn("group", F.xxhash64("label", F.size("embedding"))))
    routed = grown(classes.select("cid", "group", "mult", "embedding"), trees, leaf, spill, sample, spread_bytes)
    dealt = routed.withColumn("leaf", F.explode("leaves"))
    blocks = dealt.groupBy("group", "leaf").agg(F.count("*").alias("n"), F.ceil(F.count("*") / cap).cast("int").alias("blocks")).where("n > 1")
    dealt = dealt.join(blocks, ["group", "leaf"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks", "n")
    met = durable(dealt.groupBy("group", "leaf", "i", "j").applyInPandas(lambda pdf: compare(pdf, cosine), "cid long, w long, low long"))
    comp = components(met.where("cid <> low").select(F.col("cid").alias("a"), F.col("low").alias("b")))
    named = classes.join(met.groupBy("cid").agg(F.sum("w").alias("w")), "cid", "left").join(comp.withColumnRenamed("id", "cid"), "cid", "left")
    named = named.select("label", "h1", "h2", "least", (F.coalesce("w", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("comp", "cid").alias("c"))
    first = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.drop("least").join(first, "c")
    got = rows.drop("embedding").withColumn("label", F.when(F.col("fine"), F.col("label"))).join(named, ["label", "h1", "h2"], "left")
    comp_id = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = durable(got.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.col("vec_id").eqNullSafe(comp_id).alias("kept")))
    release(classes, routed, met, comp)
    return out


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
