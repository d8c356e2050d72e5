"""Operator 1: SentencePiece encoding and decoding by shared-prefix Viterbi.

Map-side only: every task reads its texts, segments the distinct pre-tokens it
has not kept yet in trie order (see ``pieces``) and joins the kept piece ids.
No shuffle, no collected state; a lost task is simply run again.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, table
from foliant.llm.pieces import Kept, file_of, marked, model, pre_tokens

MODEL = "piece_bpe_32k.model"


@functools.lru_cache(2)
def encoder(path: str):
    """A function from a list of texts to their piece ids as int32 bytes; a
    worker process has one, whose kept pre-tokens serve all its tasks."""
    m, kept = model(path), Kept()

    def make(keys: list[str]) -> list[bytes]:
        return [np.array(x, "<i4").tobytes() for x in m.segment([marked(k) for k in keys])]

    def run(texts: list[str | None]) -> list[bytes]:
        keys = [pre_tokens(t or "") for t in texts]
        view = kept.view([k for x in keys for k in x], make)
        return [b"".join(map(view.__getitem__, x)) for x in keys]

    return run


def encode(docs: DataFrame, tokenizer: str = MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Piece ids of every whole text, as the library's encode gives them.

    Returns the columns of ``keep`` and pieces array<int>; with ``digest``
    instead n_pieces long, ids_sha256 (of the ids as little-endian int32) and
    round_trip boolean (decoding the ids gives the text back).  A null text is
    empty and has no pieces; U+2581 in a text decodes to a space, as the library
    has it; repeated rows stay; other columns are ignored.
    """
    path = file_of(tokenizer)
    small_batches(docs.sparkSession)
    head = docs.select(*keep).schema
    kinds = "n_pieces long, ids_sha256 string, round_trip boolean" if digest else "pieces array<int>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(path)
        m = model(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            ids = run(texts)
            if digest:
                back = [m.decode(np.frombuffer(x, "<i4").tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
                out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(back, pa.bool_())]
                names = ["n_pieces", "ids_sha256", "round_trip"]
            else:
                offs = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                out, names = [pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["pieces"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], [*keep, *names])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(task, f"{fields}, {kinds}")


def decode(encoded: DataFrame, tokenizer: str = MODEL, pieces: str = "pieces", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The text of every row's piece ids, in column text; null ids give null."""
    path = file_of(tokenizer)
    small_batches(encoded.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if x is None else m.decode(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return encoded.select(*keep, pieces).mapInArrow(task, f"{fields}, text string")


def op1_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 and round_trip of every document."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)
