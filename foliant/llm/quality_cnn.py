"""Operator 7: quality classifier, a byte-level convolutional network in numpy.

A text is cut into chunks of CHUNK bytes, each overlapping the next, that cover
all of it.  FILTERS learned filters of WIDTH bytes slide over each chunk, their
rectified outputs are max-pooled per chunk, and the mean and maximum over the
chunks go through one logistic unit to the probability that a reader would mark
the text as good.  A filter's response is a sum of one table entry per byte
pair, so a chunk costs WIDTH / 2 look-ups a byte.

The network is fitted on a sample of at most SAMPLE labelled documents, on all
chunks of each, as it scores.  Texts stay on executors: the sample is dealt to
at most SHARDS shards of SHARD_ROWS or more, each of which makes one pass of stochastic gradient steps a round
from the common weights, and the shards' weights are averaged.  A document's
chunks are seen some at a time, so no text is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import crc_mod, durable, release, small_batches, table
from foliant.llm.textkit import slices

CHUNK, STRIDE, WIDTH, FILTERS = 512, 448, 6, 16
SAMPLE, SHARDS, ROUNDS, BATCH, RATE = 4_000, 6, 10, 8, 0.03
SHARD_ROWS, SLICE = 400, 256
BATCH_BYTES = 4 << 20
SEED = 11
CUT = 0.3
PRIOR = 0.7


def chunk_spans(size: int) -> list[tuple[int, int]]:
    """Spans of the chunks that cover ``size`` bytes; an empty text has none."""
    if size <= 0:
        return []
    starts = range(0, max(1, size - (CHUNK - STRIDE)), STRIDE)
    return [(a, min(size, a + CHUNK)) for a in starts]


def laid_out(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end with a gap of zero bytes after each, so that no
    window reaches into the next; the spans of their chunks in that; the bounds
    of each text's chunks."""
    sizes, gap = np.diff(offs), WIDTH
    base = offs[:-1] + gap * np.arange(len(sizes))
    wide = np.zeros(len(data) + gap * len(sizes) + CHUNK + WIDTH, np.uint8)
    wide[np.arange(len(data)) + np.repeat(gap * np.arange(len(sizes)), sizes)] = data
    spans, first = [], [0]
    for b, s in zip(base.tolist(), sizes.tolist(), strict=True):
        spans += [(b + x, b + y) for x, y in chunk_spans(s)]
        first.append(len(spans))
    return wide, np.array(spans, np.int64).reshape(-1, 2), np.array(first)


class Network:
    """Weights: byte table WIDTH x 256 x FILTERS, biases, logistic unit."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.shift = np.zeros(1, np.float32)
        self.pairs: np.ndarray | None = None

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.out, self.shift]

    def ready(self) -> Network:
        """Tables of byte pairs for scoring: entry of (first, second) byte."""
        t = self.table
        self.pairs = np.ascontiguousarray((t[0::2, :, None, :] + t[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS))
        return self

    def pooled(self, wide: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Max-pooled responses of each chunk; a chunk's windows start inside it
        and may end in the gap after its text."""
        out = [np.zeros((0, FILTERS), np.float32)]
        for a in range(0, len(spans), SLICE):
            some = spans[a : a + SLICE]
            data = wide[some[0, 0] : some[-1, 1] + WIDTH]
            pair = data[:-1].astype(np.int32) * 256 + data[1:]
            n = len(data) - WIDTH + 1
            r = self.pairs[0][pair[:n]]
            for k in range(1, WIDTH // 2):
                r += self.pairs[k][pair[2 * k : 2 * k + n]]
            last = np.maximum(some[:, 1] - (WIDTH - 1), some[:, 0] + 1)
            edges = np.stack([some[:, 0], last], 1).ravel() - some[0, 0]
            out.append(np.maximum(np.maximum.reduceat(r, edges, axis=0)[::2] + self.bias, 0))
        return np.concatenate(out)

    def features(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean and maximum over each document's chunks; ``first`` has the
        bounds of the documents' chunks, a document may have none."""
        n = len(first) - 1
        out = np.zeros((n, 2 * FILTERS), np.float32)
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            out[some, :FILTERS] = np.add.reduceat(pooled, first[some], axis=0) / np.diff(first)[some, None]
            out[some, FILTERS:] = np.maximum.reduceat(pooled, first[some], axis=0)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ self.out + float(self.shift[0]), -30, 30)))

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probabilities of a run of texts."""
        wide, spans, first = laid_out(data, offs)
        return self.probability(self.features(self.pooled(wide, spans), first))

    def peaks(self, wide: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled responses of each chunk and where each filter's is, from
        the byte table itself."""
        pooled, top = [], []
        for a in range(0, len(spans), SLICE):
            at, end = spans[a : a + SLICE].T
            raw = wide[at[:, None] + np.arange(CHUNK + WIDTH - 1)]
            r = self.table[0][raw[:, :CHUNK]]
            for k in range(1, WIDTH):
                r += self.table[k][raw[:, k : k + CHUNK]]
            windows = np.maximum(end - at - (WIDTH - 1), 1)
            r[np.arange(CHUNK)[None, :] >= windows[:, None]] = -1e9
            best = r.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(r, best[:, None, :], 1)[:, 0] + self.bias, 0))
            top.append(best + at[:, None])
        if not pooled:
            return np.zeros((0, FILTERS), np.float32), np.zeros((0, FILTERS), np.int64)
        return np.concatenate(pooled), np.concatenate(top)

    def gradient(self, data: np.ndarray, offs: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean log loss of a run of texts, by ``weights``."""
        wide, spans, first = laid_out(data, offs)
        pooled, top = self.peaks(wide, spans)
        f = self.features(pooled, first)
        g = ((self.probability(f) - y) * weight / len(y)).astype(np.float32)
        d_f, counts = g[:, None] * self.out, np.diff(first)
        own = np.repeat(np.arange(len(y)), counts)
        d_pool = d_f[own, :FILTERS] / np.maximum(counts, 1)[own, None]
        best = f[own, FILTERS:] == pooled
        d_pool = (d_pool + np.where(best, d_f[own, FILTERS:], 0)) * (pooled > 0)
        d_table = np.zeros_like(self.table)
        c, j = np.nonzero(d_pool)
        for k in range(WIDTH):
            np.add.at(d_table[k], (wide[top[c, j] + k], j), d_pool[c, j])
        return [d_table, d_pool.sum(0), f.T @ g, np.array([g.sum()], np.float32)]


class State:
    """A network with the moments of its gradients (Adam), as one vector that
    can be averaged."""

    def __init__(self, net: Network, seed: int = SEED) -> None:
        # the logistic unit starts off 0, so that the filters learn at once
        net.out += np.random.default_rng(seed + 1).normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.net, self.step = net, 0
        self.mean = [np.zeros_like(w) for w in net.weights()]
        self.square = [np.zeros_like(w) for w in net.weights()]

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.net.weights(), *self.mean, *self.square)])

    def load(self, v: np.ndarray, step: int) -> None:
        at = 0
        for x in (*self.net.weights(), *self.mean, *self.square):
            x[...] = v[at : at + x.size].reshape(x.shape)
            at += x.size
        self.step = step

    def learn(self, data: np.ndarray, offs: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        grads = self.net.gradient(data, offs, y, weight)
        self.step += 1
        for i, (w, d, m, v) in enumerate(zip(self.net.weights(), grads, self.mean, self.square, strict=True)):
            d = d + 1e-4 * w if i in (0, 2) else d
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            w -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)


def fit(rows: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> Network:
    """Fits on the rows (doc_id, quality, text) of a bounded table: the log
    loss, in which good texts weigh PRIOR in all.  Without examples of both the
    network says 0.5 or their label.  The result doesn't depend on how the rows
    are stored."""
    net = Network(seed)
    n = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        net.shift[0] = 0 if not n else (4 if 1 in n else -4)
        return net.ready()
    weigh = {1: PRIOR * (n[0] + n[1]) / n[1], 0: (1 - PRIOR) * (n[0] + n[1]) / n[0]}
    state, many = State(net, seed), max(1, min(SHARDS, sum(n.values()) // SHARD_ROWS))
    shards = rows.select("quality", "text", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(many)).alias("shard"), F.xxhash64("doc_id", "quality", "text").alias("order"))
    for k in range(rounds):
        dealt = shards.select("shard", "quality", "text", F.xxhash64("order", F.lit(k)).alias("order")).repartitionByRange(many, "shard").sortWithinPartitions("shard", "order")
        spread = rows.sparkSession.sparkContext.broadcast((state.vector(), state.step))
        rate = RATE * 0.5 ** (4 * k / rounds)

        def task(batches: Iterator[pa.RecordBatch], spread=spread, rate=rate) -> Iterator[pa.RecordBatch]:
            own, now, held, done = State(Network()), None, [], 0

            def learn() -> None:
                nonlocal held
                if held:
                    data = np.frombuffer(b"".join(t for _, t in held), np.uint8)
                    y = np.array([q for q, _ in held], np.float32)
                    own.learn(data, np.concatenate([[0], np.cumsum([len(t) for _, t in held])]), y, np.array([weigh[q] for q, _ in held], np.float32), rate)
                held = []

            def result() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int64()), "n": pa.array([done], pa.int64()), "blob": pa.array([own.vector().tobytes()], pa.binary())})

            for batch in batches:
                for shard, quality, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                    if shard != now:
                        if now is not None:
                            learn()
                            yield result()
                        own.load(*spread.value)
                        now, done = shard, 0
                    held.append((quality, (text or "").encode()))
                    done += 1
                    if len(held) == BATCH or sum(len(t) for _, t in held) > BATCH_BYTES:
                        learn()
            if now is not None:
                learn()
                yield result()

        got = sorted((r["shard"], r["n"], bytes(r["blob"])) for r in dealt.mapInArrow(task, "shard long, n long, blob binary").collect())
        share = np.array([x[1] for x in got]) / sum(x[1] for x in got)
        state.load((share[:, None] * np.stack([np.frombuffer(x[2], np.float32) for x in got])).sum(0), state.step + -(-max(x[1] for x in got) // BATCH))
        spread.unpersist()
    return net.ready()


def train(docs: DataFrame, labels: DataFrame, chosen: Column, sample: int = SAMPLE) -> Network:
    """Fits on the labelled rows where ``chosen`` (on doc_id) holds: the at most
    ``sample`` of them with the lowest hash of doc_id, half of each label where
    there are as many, and of several texts of one id the least.  Rows with a
    null label or id are not used."""
    good = labels.where(F.col("quality").isin(0, 1) & chosen & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    ids = [good.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample // 2) for q in (0, 1)]
    few = F.broadcast(ids[0].union(ids[1]))
    small_batches(docs.sparkSession)
    rows = durable(docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    net = fit(rows)
    release(rows)
    return net


def classify(docs: DataFrame, network: Network, keep: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """Scores every whole text: the columns of ``keep``, score (0 to 1, higher
    is better) and predicted (1 if score >= ``cut``).  A null or empty text has
    no chunk and gets the network's score for that; repeated rows stay."""
    small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(network.weights())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.table, net.bias, net.out, net.shift = spread.value
        net.ready()
        for batch in batches:
            for a, b, data, offs in slices(batch.columns[len(keep)], 200_000):
                p = net.score(data, offs)
                kept = [batch.columns[i].slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= cut).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(task, f"{fields}, score double, predicted int")


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = crc_mod(F.col("doc_id"), 5) == 0
    network = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), ~out)
    return classify(docs, network).select("doc_id", out.alias("held_out"), "score", "predicted")
