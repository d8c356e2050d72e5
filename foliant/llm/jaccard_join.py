"""Operator 2: n-gram Jaccard self-join by T-occurrence search.

Two texts link when their sets of word shingles have Jaccard similarity of at
least NUM / 100.  An overlap of T shingles is then required, and every linked
pair shares one of the n - T + 1 shingles of either text that come first in any
common order.  The order here is rarest first:

1. Shingles found in one text only cannot be shared.  Every text emits its
   shingle hashes once (copies in one task once), a grouped count keeps those of
   two or more texts, and a Bloom filter of bounded size takes them to the scan.
2. The texts' shared shingles are joined with their counts; a text whose unique
   shingles already make up n - T + 1 links with nothing.  The others enter the
   inverted lists of their rarest shared shingles.
3. Texts that meet in a list form candidate clusters (connected components of
   one edge for each list entry, never of all pairs in a list).
4. Within a cluster the search is local: inverted lists over the cluster's
   texts, the short ones merged by a heap, the long ones only probed by binary
   search for what the merge has found (DivideSkip).  Candidates already
   connected are passed over.  A cluster of over BLOCK shingles is cut into
   blocks: blocks are searched alone, then each block's texts outside its main
   component, with one text of the main component, against all other blocks,
   then these main components against each other wherever they are still apart.
   So no task holds a cluster of unbounded size and no link between components
   is lost.

Texts with equal sets are one vertex throughout.  Shingles are identified by a
64-bit hash of their words and sets by one of their sorted shingle hashes; two
that agree are taken as equal.  Rows are told apart by doc_id and text, so one id
may stand on several texts, and rows without an id are linked like any other.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bitset
from foliant.llm.common import components, durable, release, small_batches, table
from foliant.llm.textkit import SHINGLE, Words, column, mix, shingle_sets, slices

NUM = 75
BLOCK = 2_000_000
#: Cost of a step of the merge against that of a probe, as it weighs in the number of long lists.
MU = 0.002


def set_key(h: np.ndarray) -> int:
    """64-bit identity of a sorted set of hashes; 0 is the empty set's."""
    if not len(h):
        return 0
    return int((mix(np.array([mix(h ^ np.uint64(0xA5A5A5A5)).sum() + np.uint64(len(h))], np.uint64))[0] | np.uint64(1)).astype(np.int64))


def required(n: np.ndarray | int, num: int = NUM):
    """Overlap that a set of n needs with any partner at all."""
    return -(-n * num // 100)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for a, b, data, offs in slices(column(batch, "text")):
            yield batch.slice(a, b - a), shingle_sets(Words(data, offs), width)


def text_key(text: str = "text") -> Column:
    """64-bit identity of a text, with doc_id that of a row."""
    return F.xxhash64(text)


def _hashes(docs: DataFrame, width: int) -> DataFrame:
    """Every distinct shingle of every text; equal sets of one task once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, width):
            new = []
            for s in sets:
                k = set_key(s)
                if k and k not in seen:
                    seen.add(k)
                    new.append(s)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(np.sort(np.concatenate(new)).view(np.int64))], ["h"])

    return docs.select("text").mapInArrow(task, "h long")


def sketch(docs: DataFrame, shared: bitset.Filter, width: int = SHINGLE, num: int = NUM) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, hits) of every row: hits are the shingles
    in ``shared`` of a text that has enough of them to link, given once for
    equal sets of one task and else empty."""
    spread = docs.sparkSession.sparkContext.broadcast((shared.blocks, shared.bits))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, none = bitset.Filter(*spread.value), set(), np.zeros(0, np.uint64)
        for rows, sets in _sets(batches, width):
            keys, hits = [], []
            for s in sets:
                k, hit = set_key(s), none
                if k and k not in seen:
                    seen.add(k)
                    hit = s[found.has(s)]
                    if len(s) - len(hit) >= len(s) - required(len(s), num) + 1:
                        hit = none
                keys.append(k)
                hits.append(hit)
            offs = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in hits])]).astype(np.int32))
            flat = pa.array(np.concatenate([*hits, none]).view(np.int64))
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offs, flat)]
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), column(rows, "text_key"), *made], ["doc_id", "text_key", "n_shingles", "set_key", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", text_key().alias("text_key"))
    return keyed.mapInArrow(task, f"doc_id {kind}, text_key long, n_shingles long, set_key long, hits array<long>")


def shared_shingles(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(h, df) of the shingles of two texts or more."""
    return _hashes(docs, width).repartition("h").groupBy("h").agg(F.count("*").cast("int").alias("df")).where("df > 1")


def candidate_lists(sets: DataFrame, counts: DataFrame, num: int = NUM) -> DataFrame:
    """(h, set_key): the inverted-list entries that can witness a link."""
    rows = sets.where(F.size("hits") > 0).select("set_key", F.col("n_shingles").alias("n"), F.explode("hits").alias("h"))
    rows = rows.dropDuplicates(["set_key", "h"]).join(counts, "h")
    per = rows.groupBy("set_key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    missing = (F.col("n") - F.ceil(F.col("n") * num / 100) + 1 - (F.col("n") - F.size("shared"))).cast("int")
    per = per.where(missing > 0).select("set_key", F.explode(F.slice("shared", 1, missing)).alias("s"))
    return per.select(F.col("s.h").alias("h"), "set_key")


class Parts:
    """Disjoint sets of 0 .. n - 1; ``label`` says which set each is in.  The
    smaller set is relabelled, so n joins relabel n log n entries at most."""

    def __init__(self, comp: np.ndarray) -> None:
        _, self.label = np.unique(comp, return_inverse=True)
        order = np.argsort(self.label, kind="stable")
        cuts = np.cumsum(np.bincount(self.label))[:-1] if len(order) else []
        self.members = dict(enumerate(np.split(order, cuts)))

    def join(self, i: int, j: int) -> bool:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] = np.concatenate([self.members[a], self.members.pop(b)])
        return True


def merge_skip(lists: list[list[int]], t: int) -> Iterator[tuple[int, int]]:
    """(entry, count) of the entries that stand in at least ``t`` of the sorted
    ``lists``.  A heap holds the head of every list.  Heads below the t-th are
    too few to make up ``t``: their lists jump by binary search to that head."""
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= t:
        low, out = heap[0][0], []
        while heap and heap[0][0] == low:
            out.append(heapq.heappop(heap)[1])
        if len(out) >= t:
            yield low, len(out)
            for k in out:
                at[k] += 1
        else:
            while heap and len(out) < t - 1:
                out.append(heapq.heappop(heap)[1])
            if not heap:
                return
            for k in out:
                at[k] = bisect.bisect_left(lists[k], heap[0][0], at[k])
        for k in out:
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))


def divided(need: int, longest: int, mu: float = MU) -> int:
    """How many of a text's lists are long, at least one fewer than it needs."""
    return max(0, min(need - 1, int(need / (mu * math.log2(max(longest, 1)) + 1))))


def t_occurrence(sets: list[np.ndarray], comp: np.ndarray, ask: np.ndarray, num: int = NUM, mu: float = MU) -> list[tuple[int, int]]:
    """Links that connect ``comp``'s components, found for the texts in ``ask``.

    Of two texts that ask the smaller one does.  A text of m shingles then needs
    T = 2 * num / (100 + num) * m of them in a partner, or num / 100 * m where
    texts are searched that don't ask.  Of its m inverted lists the L longest are
    long, L = T / (mu * log2(length of the longest) + 1) as DivideSkip divides them.
    The others are merged by a heap that skips to what stands in T - L of them;
    the long lists are only searched, by bisection, for what is found, the
    shortest first, until it can't reach what it needs.  Texts of the own
    component and texts that are too large or too small are left out.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    by_size = np.argsort(size, kind="stable")
    sets, size, comp, ask = [sets[i] for i in by_size.tolist()], size[by_size], comp[by_size], ask[by_size]
    own = np.repeat(np.arange(n), size)
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    ids, first, much = np.unique(h[order], return_index=True, return_counts=True)
    own = own[order]
    parts, all_ask = Parts(comp), bool(ask.all())
    links = []
    for q in np.flatnonzero(ask).tolist():
        m = int(size[q])
        need = int(required(m, num)) if not all_ask else -(-2 * num * m // (100 + num))
        at = np.searchsorted(ids, sets[q])
        at = at[np.argsort(much[at], kind="stable")]
        many = divided(need, int(much[at[-1]]), mu)
        short, long_ = at[: m - many], at[m - many :].tolist()
        low = q + 1 if all_ask else int(np.searchsorted(size, -(-num * m // 100)))
        high = int(np.searchsorted(size, 100 * m // num, "right"))
        lists = []
        for k in short[much[short] > 1].tolist():
            x = own[first[k] : first[k] + much[k]]
            x = x[np.searchsorted(x, low) : np.searchsorted(x, high)]
            x = x[parts.label[x] != parts.label[q]]
            lists.append((x if all_ask else x[(x > q) | ~ask[x]]).tolist())
        found = list(merge_skip(lists, need - many))
        if not found:
            continue
        c, o = np.array(found).T
        # overlap o gives 100 * o >= num * (m + other - o)
        want = -(-num * (m + size[c]) // (100 + num))
        left = len(long_)
        for k in long_:
            near = o + left >= want
            if not near.all():
                c, o, want = c[near], o[near], want[near]
                if not len(c):
                    break
            x = own[first[k] : first[k] + much[k]]
            o = o + (x[np.minimum(np.searchsorted(x, c), len(x) - 1)] == c)
            left -= 1
        for x in c[o >= want].tolist():
            if parts.join(x, q):
                links.append((int(by_size[x]), int(by_size[q])))
    return links


def _local(pdf: pd.DataFrame, width: int, num: int) -> list[tuple[int, int]]:
    """Links (as set keys) within a group of (set_key, comp, ask, text) rows."""
    texts = pa.array(pdf["text"].tolist(), pa.large_string())
    sets: list[np.ndarray] = []
    for _, _, data, offs in slices(texts):
        sets += shingle_sets(Words(data, offs), width)
    key = pdf["set_key"].to_numpy()
    return [(int(key[a]), int(key[b])) for a, b in t_occurrence(sets, pdf["comp"].to_numpy(), pdf["ask"].to_numpy(), num)]


def _search(groups: DataFrame, by: list[str], width: int, num: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_local(pdf, width, num), columns=["a", "b"], dtype="int64")

    return groups.groupBy(*by).applyInPandas(one, "a long, b long")


def links(docs: DataFrame, sets: DataFrame, counts: DataFrame, width: int = SHINGLE, num: int = NUM, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between set keys that span every component of the links."""
    lists = durable(candidate_lists(sets, counts, num))
    low = lists.groupBy("h").agg(F.min("set_key").alias("low"))
    chains = components(lists.join(low, "h").where("set_key <> low").select(F.col("low").alias("a"), F.col("set_key").alias("b")))
    one = sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n"))
    held = durable(chains.withColumnRenamed("id", "set_key").join(one, "set_key").select("set_key", "comp", "n", "row.*"))
    release(lists, chains)
    load = held.groupBy("comp").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    near = held.join(load, "comp").select("set_key", "doc_id", "text_key", F.col("comp").alias("cluster"), "blocks", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int").alias("block"))
    rows = durable(_texts(docs, near))
    alone = rows.select("cluster", "block", "set_key", F.col("set_key").alias("comp"), F.lit(True).alias("ask"), "text")
    found = durable(_search(alone, ["cluster", "block"], width, num))
    release(held)
    if not rows.where("blocks > 1").isEmpty():
        found = _across(rows.where("blocks > 1"), found, width, num)
    release(rows)
    return found


def _texts(docs: DataFrame, near: DataFrame) -> DataFrame:
    """``near`` with the texts of its rows, one of each set; a Bloom filter of
    the rows keeps the others out of the shuffle, as are repeated rows of a task."""
    held = bitset.build(near.select(F.xxhash64("doc_id", "text_key").alias("k")), "k", near.count())
    spread = docs.sparkSession.sparkContext.broadcast((held.blocks, held.bits))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = bitset.Filter(*spread.value), set()
        for batch in batches:
            k = column(batch, "k").to_numpy()
            new = found.has(k.view(np.uint64))
            for i in np.flatnonzero(new).tolist():
                new[i] = k[i] not in seen
                seen.add(k[i])
            yield batch.filter(pa.array(new))

    few = docs.select("doc_id", "text", text_key().alias("text_key")).withColumn("k", F.xxhash64("doc_id", "text_key"))
    kept = few.mapInArrow(task, few.schema).drop("k").alias("t")
    rows = kept.join(near.alias("n"), F.col("t.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("t.text_key") == F.col("n.text_key")))
    return rows.select("cluster", "blocks", "block", "set_key", "text").dropDuplicates(["set_key"])


def _across(rows: DataFrame, found: DataFrame, width: int, num: int) -> DataFrame:
    """Links between the blocks of the clusters that were cut."""

    def labelled(of: DataFrame, edges: DataFrame) -> DataFrame:
        comp = components(edges).withColumnRenamed("id", "set_key")
        return of.join(comp, "set_key", "left").withColumn("comp", F.coalesce("comp", "set_key"))

    def mains(of: DataFrame) -> DataFrame:
        n = of.groupBy("cluster", "block", "comp").agg(F.count("*").alias("c"), F.min("set_key").alias("pivot"))
        return n.groupBy("cluster", "block").agg(F.max_by(F.struct("comp", "pivot"), F.struct("c", "comp")).alias("main")).select("cluster", "block", "main.comp", "main.pivot")

    now = durable(labelled(rows, found))
    main = durable(mains(now.drop("text")).select("cluster", "block", F.col("comp").alias("main"), "pivot"))
    rest = now.join(main, ["cluster", "block"]).where("comp <> main or set_key = pivot").select("cluster", "blocks", F.col("block").alias("of"), "set_key", "comp", "text")
    asked = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> of").withColumn("ask", F.lit(True))
    there = now.join(rest.select("cluster", "of").distinct(), "cluster").where("of <> block").select("cluster", "of", "set_key", "comp", "text", "block", F.lit(False).alias("ask"))
    more = durable(_search(asked.select(there.columns).union(there), ["cluster", "of", "block"], width, num))
    found, old = durable(found.union(more)), (found, more, now)
    release(*old[:2])
    # All but the texts of two such main components have been compared by now.
    now = labelled(now.withColumnRenamed("comp", "first"), found)
    now = durable(now.join(main, ["cluster", "block"]).where("first = main").select("cluster", "block", "set_key", "comp", "text", "pivot"))
    main = now.where("set_key = pivot").select("cluster", "block", "comp")
    apart = main.alias("x").join(main.alias("y"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") < F.col("y.block")) & (F.col("x.comp") != F.col("y.comp")))
    apart = apart.select("x.cluster", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    left = apart.join(now.withColumnRenamed("block", "i"), ["cluster", "i"]).select("cluster", "i", "j", "set_key", "comp", "text", F.lit(True).alias("ask"))
    right = apart.join(now.withColumnRenamed("block", "j"), ["cluster", "j"]).select("cluster", "i", "j", "set_key", "comp", "text", F.lit(False).alias("ask"))
    last = durable(found.union(_search(left.union(right), ["cluster", "i", "j"], width, num)))
    release(found, now, old[2])
    return last


def join(docs: DataFrame, width: int = SHINGLE, num: int = NUM, block: int = BLOCK) -> DataFrame:
    """Similarity classes of ``docs`` (doc_id, text).

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable
    by links, one row for each row of ``docs``; further text_key, with doc_id the
    row's identity, and class_id, the same number for all rows of a class.  A
    document's set holds its distinct ``width``-word shingles, or its whole word
    sequence when it has fewer words; null, empty and blank texts have no set,
    link with nothing and have no class_id.  Equal sets always link.  Rows
    without an id link too: their component_id is the class's smallest id that
    is not null.  Repeated rows stay, as do several texts of one id; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    counts = durable(shared_shingles(docs, width))
    sets = durable(sketch(docs, bitset.build(counts, "h", counts.count()), width, num))
    edges = links(docs, sets.where("n_shingles > 0"), counts, width, num, block)
    chains = components(edges)
    comp = chains.select(F.col("id").alias("set_key"), "comp")
    release(counts, edges)
    classes = sets.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("low"))
    classes = durable(classes.join(comp, "set_key", "left").withColumn("comp", F.coalesce("comp", "set_key")))
    least = classes.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = classes.join(least, "comp").select("set_key", "component_id", F.col("comp").alias("class_id"))
    out = sets.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_key", "class_id")
    out = durable(out)
    release(sets, classes, chains)
    return out


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key and class_id of every document."""
    return join(table(spark, sf_dir, "documents", "doc_id", "text"))
