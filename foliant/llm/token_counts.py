"""Operator 3: token counts by a map-side two-tier lookup.

Tier one is a compact table of the frequent pre-tokens' lengths, broadcast once;
tier two is each worker's bounded cache of the others, kept from task to task and
filled by encoding the misses of a batch with the library.  The frequent pre-tokens come from every
task's own bounded summary of its texts (counters that are thinned when full),
merged in a tree: summaries move, pre-tokens don't, and an inexact summary
costs time only, since both tiers hold exact lengths.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import merged, small_batches, table
from foliant.llm.pieces import CACHED_CHARS, Kept, file_of, library, library_input, pre_tokens

MODEL = "piece_bpe_32k.model"
FREQUENT = 65_536
TASK_FREQUENT = 16_384
HELD = 200_000
LIMIT = 4096
ROWS = 512


@functools.lru_cache(2)
def cache(path: str) -> Kept:
    """Tier two of a worker process, which serves all its tasks."""
    return Kept()


def pack(words: list[str], numbers: list[int]) -> bytes:
    """Strings and their numbers as one compressed blob: lengths, numbers, then
    the UTF-8 of all strings."""
    raw = [w.encode() for w in words]
    head = np.array([len(raw)], "<i8").tobytes() + np.array(list(map(len, raw)), "<i4").tobytes() + np.array(numbers, "<i8").tobytes()
    return zlib.compress(head + b"".join(raw), 1)


def unpack(blob: bytes) -> dict[str, int]:
    data = zlib.decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<i4", n, 8)).tolist()
    numbers = np.frombuffer(data, "<i8", n, 8 + 4 * n).tolist()
    body = data[8 + 12 * n :]
    return {body[a:b].decode(): v for a, b, v in zip([0, *ends[:-1]], ends, numbers, strict=True)} if n else {}


def top(counts: Counter, n: int) -> bytes:
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]
    return pack([k for k, _ in best], [v for _, v in best])


def frequent(docs: DataFrame, text: str = "text", size: int = FREQUENT) -> list[str]:
    """The pre-tokens most frequent in all texts, most frequent first."""
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(pre_tokens(t or ""))
            while len(held) > HELD:
                least = sorted(held.values())[len(held) // 2]
                held = Counter({k: v for k, v in held.items() if v > least})
        held = Counter({k: v for k, v in held.items() if v > 1 and len(k) <= CACHED_CHARS})
        if held:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "blob": pa.array([top(held, TASK_FREQUENT)], pa.binary())})

    def merge(blobs: list[bytes]) -> bytes:
        total: Counter = Counter()
        for b in blobs:
            total.update(unpack(bytes(b)))
        return top(total, size)

    blob = merged(docs.select(text).mapInArrow(task, "part int, blob binary"), merge)
    return list(unpack(blob)) if blob else []


def count(docs: DataFrame, tokenizer: str = MODEL, text: str = "text", limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",), size: int = FREQUENT) -> DataFrame:
    """Tokens of every whole text as the library counts them, nothing added.

    Returns the columns of ``keep``, n_bytes long, n_tokens long, over_limit
    boolean (n_tokens > ``limit``).  A null text is empty and has 0 of both;
    repeated rows stay; an empty table gives no rows.
    """
    path = file_of(tokenizer)
    small_batches(docs.sparkSession)

    def lengths(keys: list[str]) -> list[int]:
        asked = [library_input(k) for k in keys]
        return [len(x) - extra for x, (_, extra) in zip(library(path).encode([t for t, _ in asked], num_threads=1), asked, strict=True)]

    words = frequent(docs, text, size)
    spread = docs.sparkSession.sparkContext.broadcast(pack(words, lengths(words) if words else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier1, tier2 = unpack(spread.value), cache(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
                parts = [pre_tokens(t) for t in texts]
                found = [list(map(tier1.get, keys)) for keys in parts]
                missed = [[k for k, n in zip(keys, got, strict=True) if n is None] for keys, got in zip(parts, found, strict=True)]
                view = tier2.view([k for x in missed for k in x], lengths)
                n = [sum(filter(None, got)) + sum(map(view.__getitem__, lost)) for got, lost in zip(found, missed, strict=True)]
                out = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], [*keep, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(task, f"{fields}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    return count(table(spark, sf_dir, "documents", "doc_id", "text"))
