"""Operator 6: language-model scoring with a hidden Markov model.

Tokens.  Words are white-space runs with A-Z in lower case, each identified by a
64-bit hash; every text ends with one end token.  Counts of all training tokens
are a grouped sum whose rows are already summed by task.

Symbols.  The model emits at most SYMBOLS frequent tokens as themselves and the
others by one of BUCKETS classes of word endings; a rare word then has the
probability (c + 0.5) / (mass of its class), where one unseen word per class has
c = 0.  So the model gives every token sequence a proper probability.

Training.  Baum-Welch over all training texts: each task runs the scaled
forward-backward recursion on its texts, cut into windows of WINDOW tokens, and
returns expected counts of fixed size, which are summed in two levels.

Scoring.  The scaled forward recursion runs over each whole text.  Counts of the
TIER most frequent tokens are broadcast; occurrences of rarer ones are joined
with the count table by hash, after summing them by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import crc_mod, durable, merged, release, small_batches, table
from foliant.llm.textkit import Words, column, mix, slices

STATES = 8
SYMBOLS = 4096
BUCKETS = 512
TIER = 500_000
ROUNDS = 4
WINDOW = 256
FLUSH = 3_000_000
ALPHA = 0.05
END = np.uint64(0x1234567887654321)
SEED = 7


def buckets_of(w: Words) -> np.ndarray:
    """Class of each word by its last three bytes."""
    data, end, start = w.data.astype(np.uint64), w.end, w.start
    x = data[end - 1]
    for k in (2, 3):
        x = x * np.uint64(256) + np.where(end - k >= start, data[np.maximum(end - k, 0)], np.uint64(0))
    return (mix(x) % np.uint64(BUCKETS)).astype(np.int64)


def counts(docs: DataFrame, chosen: Column) -> DataFrame:
    """(h, bucket, c) of every distinct token of the chosen texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ends = 0

        def summed() -> tuple:
            h, b, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            return u, b[first], np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64)

        waiting = 0
        for batch in batches:
            ends += batch.num_rows
            for _, _, data, offs in slices(column(batch, "text")):
                w = Words(data, offs)
                u, first, c = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((u, buckets_of(w)[first], c))
                waiting += len(u)
                if waiting > 1_000_000:
                    held = [summed()]
                    waiting = 0
        if ends:
            held.append((np.array([END]), np.array([-1]), np.array([ends])))
            u, b, c = summed()
            for a in range(0, len(u), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[a : a + 50_000].view(np.int64)), pa.array(b[a : a + 50_000].astype(np.int32)), pa.array(c[a : a + 50_000])], ["h", "bucket", "c"])

    got = docs.where(chosen).select("text").mapInArrow(task, "h long, bucket int, c long")
    return got.groupBy("h").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))


def _most_frequent(counted: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of at most ``n`` most frequent tokens: those
    from the least count on that no more than ``n`` tokens reach."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    hist = sorted(counted.groupBy(level.alias("l")).count().collect(), reverse=True)
    total, cut = 0, 1 << 30
    for x, k in hist:
        total += k
        if total > n:
            break
        cut = x
    got = counted.where(level >= cut).select("h", "c").toArrow()
    h, c = got.column(0).to_numpy().astype(np.int64).view(np.uint64), got.column(1).to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


class Vocabulary:
    """Symbols, broadcast counts and class masses, of bounded size."""

    def __init__(self, counted: DataFrame, symbols: int = SYMBOLS, tier: int = TIER) -> None:
        total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n, self.v = int(total[0]), int(total[1])
        self.h, self.c = _most_frequent(counted, tier)
        few, _ = _most_frequent(counted, symbols) if self.v else (np.zeros(0, np.uint64), None)
        self.symbol = few[few != END]
        mass = {r["bucket"]: r["m"] for r in counted.groupBy("bucket").agg(F.sum(F.col("c") + 0.5).alias("m")).collect() if r["bucket"] >= 0}
        self.mass = np.array([mass.get(b, 0.0) + 0.5 for b in range(BUCKETS)])
        own = {r["h"]: (r["bucket"], r["c"]) for r in counted.join(counted.sparkSession.createDataFrame([(int(x),) for x in self.symbol.view(np.int64)], "h long"), "h", "left_semi").collect()} if len(self.symbol) else {}
        for b, c in own.values():
            self.mass[b] -= c + 0.5
        self.size = 1 + len(self.symbol) + BUCKETS

    def symbols(self, hashes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """0 is the end, then the frequent tokens, then the classes."""
        k = np.searchsorted(self.symbol, hashes)
        hit = (self.symbol[np.minimum(k, len(self.symbol) - 1)] == hashes) if len(self.symbol) else np.zeros(len(hashes), bool)
        return np.where(hit, 1 + k, 1 + len(self.symbol) + bucket).astype(np.uint16)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of the tokens, -1 where they aren't among the broadcast."""
        if not len(self.h):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.h, hashes), len(self.h) - 1)
        return np.where(self.h[k] == hashes, self.c[k], -1)


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit  # K; K x K; V x K

    @staticmethod
    def initial(unigram: np.ndarray, states: int = STATES) -> Hmm:
        """States that stay, with the unigram distribution tilted at random."""
        rng = np.random.default_rng(SEED)
        emit = (unigram + 1e-9)[:, None] * np.exp(rng.normal(0, 1.0, (len(unigram), states)))
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95)
        return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def forward(self, rows: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each symbol sequence, by the scaled forward
        recursion over all of them at once, longest first."""
        size = np.array([len(r) for r in rows])
        order = np.argsort(-size, kind="stable")
        flat, begin = np.concatenate(rows), np.concatenate([[0], np.cumsum(size)[:-1]])[order]
        active = np.searchsorted(-size[order], -np.arange(size.max()), "left")
        a, out = None, np.zeros(len(rows))
        for t in range(size.max()):
            n = int(active[t])
            e = self.emit[flat[begin[:n] + t]]
            a = self.start * e if a is None else (a[:n] @ self.move) * e
            c = a.sum(1)
            a /= c[:, None]
            out[:n] += np.log(c)
        back = np.empty(len(rows))
        back[order] = out
        return back

    def expected(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions over windows, and their
        log-likelihood."""
        size = np.array([len(r) for r in rows])
        order = np.argsort(-size, kind="stable")
        most, k = int(size.max()), len(self.start)
        sym = np.zeros((most, len(rows)), np.int64)
        for i, r in enumerate(order.tolist()):
            sym[: size[r], i] = rows[r]
        active = np.searchsorted(-size[order], -np.arange(most), "left")
        e = self.emit[sym]
        alpha, scale = np.zeros_like(e), np.ones(sym.shape)
        for t in range(most):
            n = int(active[t])
            a = self.start * e[0] if t == 0 else (alpha[t - 1, :n] @ self.move) * e[t, :n]
            scale[t, :n] = c = a.sum(1)
            alpha[t, :n] = a / c[:, None]
        like = float(np.log(scale).sum())
        moves = np.zeros((k, k))
        beta = np.ones((len(rows), k))
        for t in range(most - 2, -1, -1):
            n = int(active[t + 1])
            b = e[t + 1, :n] * beta[:n] / scale[t + 1, :n, None]
            moves += alpha[t, :n].T @ b
            beta[:n] = b @ self.move.T
            alpha[t, :n] *= beta[:n]  # now the posterior of the states
        live = np.arange(most)[:, None] < size[order][None, :]
        g, s = alpha[live], sym[live]
        emits = np.stack([np.bincount(s, weights=g[:, j], minlength=len(self.emit)) for j in range(k)], 1)
        return alpha[0].sum(0), moves * self.move, emits, like


def symbol_table(docs: DataFrame, chosen: Column, vocabulary: Vocabulary) -> DataFrame:
    """The chosen texts as little-endian uint16 symbols, end included."""
    spread = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = spread.value
        for batch in batches:
            for _, _, data, offs in slices(column(batch, "text")):
                w = Words(data, offs)
                s = voc.symbols(w.hash, buckets_of(w))
                rows = [s[w.first[i] : w.first[i + 1]].tobytes() + b"\0\0" for i in range(len(w.count))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["s"])

    return docs.where(chosen).select("text").mapInArrow(task, "s binary")


def train(symbols: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, states: int = STATES) -> tuple[Hmm, list[float]]:
    """Baum-Welch over all rows of ``symbols``; also the log-likelihood of each
    round.  Without rows the model is the initial one over all symbols."""
    v, k = vocabulary.size, states
    unigram = np.full(v, 0.5)
    at = np.searchsorted(vocabulary.h, vocabulary.symbol)
    if len(vocabulary.symbol):
        unigram[1 : 1 + len(vocabulary.symbol)] = vocabulary.c[at]
    unigram[1 + len(vocabulary.symbol) :] = vocabulary.mass
    unigram[0] = max(0.5, float(vocabulary.known(np.array([END]))[0]))
    model, likes = Hmm.initial(unigram / unigram.sum(), states), []
    sc = symbols.sparkSession.sparkContext
    for _ in range(rounds):
        spread = sc.broadcast((model.start, model.move, model.emit))

        def task(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            m, total, held, waiting = Hmm(*spread.value), None, [], 0

            def add() -> None:
                nonlocal total
                got = np.concatenate([np.ravel(x) for x in m.expected(held)])
                total = got if total is None else total + got

            for batch in batches:
                for x in batch.column(0).to_pylist():
                    s = np.frombuffer(x, np.uint16)
                    for a in range(0, len(s), WINDOW):
                        held.append(s[a : a + WINDOW])
                        waiting += len(held[-1])
                        if waiting > 400_000:
                            add()
                            held, waiting = [], 0
            if held:
                add()
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "blob"])

        blob = merged(symbols.mapInArrow(task, "part int, blob binary"), lambda bs: np.sum([np.frombuffer(bytes(b)) for b in bs], axis=0).tobytes())
        if blob is None:
            break
        got = np.frombuffer(blob)
        start, move, emit = got[:k] + 1, got[k : k + k * k].reshape(k, k) + 1, got[k + k * k : -1].reshape(v, k) + ALPHA
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        likes.append(float(got[-1]))
        spread.unpersist()
    return model, likes


def _score(docs: DataFrame, vocabulary: Vocabulary, model: Hmm, keep: tuple[str, ...]) -> DataFrame:
    """One row a text: what the broadcast tables give, and the rarer tokens'
    hashes with their occurrences, to be joined."""
    spread = docs.sparkSession.sparkContext.broadcast((vocabulary, (model.start, model.move, model.emit)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, parts = spread.value
        m, held, rows, waiting, seen = Hmm(*parts), [], [], 0, 0
        log_mass = np.log10(voc.mass)
        part = TaskContext.get().partitionId()
        end_count = max(0, int(voc.known(np.array([END]))[0]))
        names = [*keep, "row", "n_tokens", "n_known", "sum_known", "model", "h", "k"]

        def flush() -> pa.RecordBatch:
            nonlocal held, rows, waiting
            like = m.forward(rows) / np.log(10)
            cols = list(zip(*held, strict=True))
            at = np.cumsum([0] + [len(x) for x in cols[0]])
            flat = [np.concatenate(c) for c in cols[1:6]]
            flat[4] = flat[4] + like
            tails = [np.concatenate(c) for c in cols[6:9]]
            offs = pa.array(np.concatenate([[0], np.cumsum(tails[0])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offs, pa.array(tails[1].view(np.int64))), pa.ListArray.from_arrays(offs, pa.array(tails[2].astype(np.int32)))]
            heads = pa.Table.from_batches([x for x in cols[0]]).combine_chunks().to_batches()[0]
            assert heads.num_rows == at[-1]
            held, rows, waiting = [], [], 0
            return pa.RecordBatch.from_arrays([*heads.columns, *(pa.array(x) for x in flat), *lists], names)

        for batch in batches:
            for a, b, data, offs in slices(batch.columns[len(keep)]):
                w = Words(data, offs)
                n, own, bucket = len(w.count), w.rows(), buckets_of(w)
                s = voc.symbols(w.hash, bucket)
                c = voc.known(w.hash)
                rare = s > len(voc.symbol)
                hit = c >= 0
                value = np.where(hit, np.log10(np.maximum(c, 0) + 0.5), 0.0)
                base = np.bincount(own, weights=value, minlength=n) + np.log10(end_count + 0.5)
                inner = np.where(rare, value - log_mass[bucket], 0.0)
                lost = np.flatnonzero(~hit)
                order = np.lexsort((w.hash[lost], own[lost]))
                lo, lh = own[lost][order], w.hash[lost][order]
                new = np.ones(len(lo), bool)
                new[1:] = (lo[1:] != lo[:-1]) | (lh[1:] != lh[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(lo)))
                ids = (np.int64(part) << 32) + seen + np.arange(n)
                seen += n
                kept = pa.RecordBatch.from_arrays([batch.columns[i].slice(a, b - a) for i in range(len(keep))], list(keep))
                held.append((kept, ids, w.count + 1, np.bincount(own[hit & (c > 0)], minlength=n) + (end_count > 0), base, np.bincount(own, weights=inner, minlength=n), np.bincount(lo[starts], minlength=n), lh[starts], times))
                end = np.zeros(1, np.uint16)
                rows += [np.concatenate([s[w.first[i] : w.first[i + 1]], end]) for i in range(n)]
                waiting += len(s) + n
                if waiting > FLUSH:
                    yield flush()
        if held:
            yield flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(task, f"{fields}, row long, n_tokens long, n_known long, sum_known double, model double, h array<long>, k array<int>")


def score(docs: DataFrame, chosen: Column, keep: tuple[str, ...] = ("doc_id",), rounds: int = ROUNDS) -> DataFrame:
    """Scores every whole text of ``docs`` by a model of the ``chosen`` ones.

    Returns the columns of ``keep``, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score (log10 of the add-half unigram
    probability) and score (log10 probability of the text under the model).  A
    null or empty text is one end token; repeated rows each count; with nothing
    to learn from every token is unseen; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    counted = durable(counts(docs, chosen))
    vocabulary = Vocabulary(counted)
    symbols = durable(symbol_table(docs, chosen, vocabulary))
    model, _ = train(symbols, vocabulary, rounds)
    release(symbols)
    rows = durable(_score(docs, vocabulary, model, keep))
    tail = rows.select("row", F.explode(F.arrays_zip("h", "k")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.k").alias("k"))
    tail = tail.join(counted.select("h", "c"), "h", "left").groupBy("row")
    tail = tail.agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("seen"))
    got = rows.drop("h", "k").join(tail, "row", "left")
    below = float(np.log10(vocabulary.n + 0.5 * (vocabulary.v + 1)))
    more = F.coalesce("more", F.lit(0.0))
    out = got.select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("sum_known") + more - F.col("n_tokens") * below).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
    out = durable(out)
    release(counted, rows)
    return out


def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every document."""
    out = crc_mod(F.col("doc_id"), 5) == 1
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, ~out).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
