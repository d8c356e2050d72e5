"""Joins and graphs (J-*, G-06, A-13)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.batches import pieces

#: Characters of needles that one search holds at once.
SHARD_CHARS = 2_000_000
#: Longest anchor of a needle, in bytes.
ANCHOR = 64
_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of twice the width."""
    x = h[:-width] * _MULTIPLIER + h[width:]
    return (x ^ (x >> np.uint64(29))) * _MULTIPLIER


class Search:
    """All of many needles at once in a text.  A needle is looked for by its
    anchor, its first 1, 2, 4 .. ANCHOR bytes, as many as it has.  The hashes of
    all windows of a text come from those of half the width, for the whole text at
    once; where one is an anchor's, its needles are compared with the text."""

    def __init__(self, needles: list[str]) -> None:
        self.always = [n for n in needles if not n]  # '' is in every text
        by: dict[int, dict[int, list[tuple[bytes, str]]]] = {}
        for n in needles:
            raw = n.encode()
            if raw:
                width = min(ANCHOR, 1 << (len(raw).bit_length() - 1))
                by.setdefault(width, {}).setdefault(int(self._hash(raw[:width])), []).append((raw, n))
        self.held = by
        self.known = {w: np.array(sorted(x), np.uint64) for w, x in by.items()}
        self.likely = {}
        for w, h in self.known.items():
            self.likely[w] = np.zeros(1 << 16, bool)
            self.likely[w][h & np.uint64(0xFFFF)] = True

    @staticmethod
    def _hash(raw: bytes) -> np.uint64:
        h, width = _CODE[np.frombuffer(raw, np.uint8)], 1
        while len(h) > 1:
            h, width = _doubled(h, width), width * 2
        return h[0]

    def find(self, text: str) -> list[str]:
        """The needles in a text, each once, in order."""
        raw = text.encode()
        out = set(self.always)
        h, width = _CODE[np.frombuffer(raw, np.uint8)], 1
        while len(h) and width <= ANCHOR:
            if width in self.known:
                at = np.flatnonzero(self.likely[width][h & np.uint64(0xFFFF)])
                found = np.searchsorted(self.known[width], h[at])
                at = at[self.known[width][np.minimum(found, len(self.known[width]) - 1)] == h[at]]
                for i in at.tolist():
                    out.update(n for b, n in self.held[width][int(h[i])] if n not in out and raw.startswith(b, i))
            h, width = _doubled(h, width) if len(h) > width else h[:0], width * 2
        return sorted(out)


def _finder(held):
    """A function of a column of texts to the needles that each contains, by one
    pass over a text with all needles at once; ``held`` is their broadcast."""

    @F.pandas_udf("array<string>")
    def find(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = Search(held.value)
        for col in frames:
            yield col.map(lambda t: None if t is None else search.find(t))

    return find


def contains_join(texts: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """J-07: pairs where a text contains a needle.

    The distinct needles, SHARD_CHARS characters at a time, are searched for all
    at once in every text where it is read; only what is found is joined back to
    the needles' rows.
    """
    few = needles.where(F.col(needle).isNotNull())
    distinct = few.select(F.col(needle).alias("_n")).distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("_n")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_CHARS))
    parts = []
    for k in range(shards):
        some = [r[0] for r in distinct.where(F.pmod(F.xxhash64("_n"), F.lit(shards)) == k).collect()]
        find = _finder(texts.sparkSession.sparkContext.broadcast(some))
        parts.append(texts.withColumn("_n", F.explode(find(F.col(text)))))
    return reduce(DataFrame.unionByName, parts).join(few, F.col("_n") == F.col(needle)).drop("_n")


def cooccurrence(members: DataFrame, group: str, member: str) -> DataFrame:
    """G-06, J-08, A-03: (source, target, weight) of members of one group.

    Members and pairs are counted first and dealt to as many tasks, so what a task
    holds doesn't grow with them; a pair of many groups is counted in parts.
    """
    spark = members.sparkSession
    two = members.select(group, member)
    one = two.repartition(pieces(spark, two.count()), group).distinct()
    of = one.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(member).alias("n"))
    n = pieces(spark, int(of.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0))).first()[0]), 1 << 20)
    a, b = one.select(group, F.col(member).alias("source")), one.select(group, F.col(member).alias("target"))
    pairs = a.join(b, group).where("source < target").select("source", "target", F.pmod(F.xxhash64(group), F.lit(16)).alias("_part"))
    part = pairs.repartition(n, "source", "target", "_part").groupBy("source", "target", "_part").agg(F.count("*").alias("weight"))
    return part.repartition(n, "source", "target").groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def degrees(edges: DataFrame, once: bool = False) -> DataFrame:
    """A-13: (node, degree) with edges counted from both ends; ``once`` where no two
    edges have the same ends, either way round."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"))))
    both = edges.select(ends.alias("x")).select("x.*")
    return both.groupBy("node").agg((F.count("other") if once else F.count_distinct("other")).alias("degree"))


def neighbours(edges: DataFrame, node: Column) -> DataFrame:
    """I-05: edges at a node, as (neighbour, weight)."""
    here = edges.where((F.col("source") == node) | (F.col("target") == node))
    return here.select(F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("neighbour"), "weight")
