"""Operator 13: alignment of two tokenizers' tokens over exact distinct texts.

Texts are deduplicated exactly: rows are grouped, hence shuffled, by the full
text, with counts added up before and after the shuffle, so that a text of many
copies is one row a task.  Each distinct text is encoded and aligned once; a pair
of ids counts as often as it is linked times the copies of its text.  Measures go
back to the rows by the sha256 of the text.

Counts of pairs are looked up in two tiers: the most frequent pairs, TIER of them
at most, are broadcast as two arrays (16 bytes a pair) and looked up where the
texts' pairs lie; the others, each of them rare, are joined by a shuffle.  So no
pair that stands in most texts meets in one task, and what is broadcast is bounded.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import durable, release, small_batches, table
from foliant.llm.pieces import BYTE, CONTROL, MARK, UNKNOWN, Kept, file_of, library, model

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
TIER = 1 << 20
#: Chunks that a library is given at once, rows that a task takes at once, and chunks that a worker keeps.
PART, ROWS, KEPT = 4096, 128, 500_000
#: A pair of ids (a, b) is the number a * BASE + b.
BASE = 1 << 31

# Chunks of a text: cut before each space or line feed behind anything that isn't
# white space.
_CHUNK = re.compile(r"[ \n]*[^ \n]+(?:(?<=\s)[ \n]+[^ \n]*)*|[ \n]+")


@functools.lru_cache(1)
def byte_of_letter() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(2)
def side_a(path: str):
    """(encode a list of texts to ids, bytes of each id) of a byte-level model."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.no_truncation()
    made.no_padding()
    letters = byte_of_letter()
    raw: list[bytes] = [b""] * made.get_vocab_size()
    with open(path, encoding="utf-8") as f:
        special = {x["id"] for x in json.load(f).get("added_tokens", ())}
    for token, i in made.get_vocab().items():
        raw[i] = token.encode() if i in special else bytes(letters[c] for c in token)
    size = np.array(list(map(len, raw)), np.int64)

    def encode(chunks: list[str]) -> list[list[int]]:
        """Chunks are given to the library as one text; a chunk that ends in white
        space, as a text's last may, is given alone."""
        alone = [k for k, c in enumerate(chunks) if c[-1].isspace()]
        apart = set(alone)
        rest = [c for k, c in enumerate(chunks) if k not in apart] if alone else chunks
        both = made.encode_batch_fast(["".join(rest), *(chunks[k] for k in alone)], add_special_tokens=False)
        ids = both[0].ids
        ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(c.encode()) for c in rest])) + 1 if rest else np.zeros(0, int)
        parts = iter([ids[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if rest else ())
        own = dict(zip(alone, both[1:], strict=True))
        return [own[k].ids if k in own else next(parts) for k in range(len(chunks))]

    return encode, raw


@functools.lru_cache(2)
def side_b(path: str):
    """(encode a list of chunks to ids, bytes of each id) of a SentencePiece model,
    which puts a space before what it is given: a chunk's own, or one that is
    taken off again before a line feed.  A space alone is asked for before one."""
    m, sp = model(path), library(path)
    raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]

    def encode(chunks: list[str]) -> list[list[int]]:
        ids = sp.encode(["\n" if c == " " else c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [x[:1] if c == " " else x if c[0] == " " else x[1:] for x, c in zip(ids, chunks, strict=True)]

    return encode, raw


def groups(ids_a: list[int], ids_b: list[int], raw_a: list[bytes], raw_b: list[bytes], text: bytes) -> tuple[bytes, int, int, bytes] | None:
    """(``a1,a2|b1;a3|b2,b3``, n_a, n_b, pairs as int64) of a chunk; None if either
    side's bytes aren't the text.  Each group has one link, of its last tokens."""
    parts_a, parts_b = [raw_a[i] for i in ids_a], [raw_b[i] for i in ids_b]
    if b"".join(parts_a) != text or b"".join(parts_b) != text:
        return None
    if len(ids_a) == len(ids_b) == 1:
        return b"%d|%d" % (ids_a[0], ids_b[0]), 1, 1, (ids_a[0] * BASE + ids_b[0]).to_bytes(8, sys.byteorder)
    found, pairs = [], array("q")
    at_a = at_b = i = j = i0 = j0 = 0
    for part in parts_a:
        at_a += len(part)
        i += 1
        while at_b < at_a:
            at_b += len(parts_b[j])
            j += 1
        if at_a == at_b:
            found.append(f"{','.join(map(str, ids_a[i0:i]))}|{','.join(map(str, ids_b[j0:j]))}")
            pairs.append(ids_a[i - 1] * BASE + ids_b[j - 1])
            i0, j0 = i, j
    return ";".join(found).encode(), len(ids_a), len(ids_b), pairs.tobytes()


@functools.lru_cache(2)
def aligner(path_a: str, path_b: str):
    """A function from a list of texts to (n_a, n_b, n_groups, n_links,
    groups_sha256, pairs, times) of each: zeros, '' and no pairs if either side's
    bytes aren't the text behind a space.

    No token of either side goes on from one chunk to the next, so a chunk is
    encoded and aligned by itself and kept by the worker: the byte-level pattern
    never takes white space behind anything else into one pre-token, and no
    piece holds a mark or a line feed behind another character.
    """
    (encode_a, raw_a), (encode_b, raw_b) = side_a(path_a), side_b(path_b)
    kept = Kept(KEPT)

    def make(chunks: list[str]) -> list[tuple | None]:
        out: list[tuple | None] = []
        for at in range(0, len(chunks), PART):
            some = chunks[at : at + PART]
            out += [groups(a, b, raw_a, raw_b, c.encode()) for a, b, c in zip(encode_a(some), encode_b(some), some, strict=True)]
        return out

    def run(texts: list[str]) -> Iterator[tuple]:
        cut = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        view = kept.view([c for x in cut for c in x], make)
        for x in cut:
            got = list(map(view.__getitem__, x))
            if not got or None in got:
                yield 0, 0, 0, 0, "", (), ()
                continue
            said, n_a, n_b, pairs = zip(*got, strict=True)
            links = np.frombuffer(b"".join(pairs), np.int64)
            yield sum(n_a), sum(n_b), len(links), len(links), hashlib.sha256(b";".join(said)).hexdigest(), *np.unique(links, return_counts=True)

    return run


def distinct(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, copies): every text that isn't null or empty, once."""
    return docs.where(F.col(text) != "").groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("copies"))


def key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def aligned(texts: DataFrame, tokenizer_a: str = A_MODEL, tokenizer_b: str = B_MODEL) -> DataFrame:
    """(_key, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of
    distinct texts (_text, copies); times is how often each pair is linked in
    one copy."""
    small_batches(texts.sparkSession)
    path_a, path_b = file_of(tokenizer_a), file_of(tokenizer_b)
    names = ["_key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def lists(found: list, kind: pa.DataType) -> pa.Array:
        offs = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = np.concatenate([np.asarray(x, np.int64) for x in found]) if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, kind))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = aligner(path_a, path_b)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                cols = list(zip(*run(batch.column(1).to_pylist()), strict=True))
                out = [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), lists(cols[5], pa.int64()), lists(cols[6], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *out], names)

    given = texts.select(key(F.col("_text")).alias("_key"), "_text", "copies")
    return given.mapInArrow(task, "_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair over all rows, and whether no pair of
    the same B id has more.  The highest counts by B id are as many rows as the
    vocabulary at most and are broadcast."""
    links = found.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    n = durable(links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.times") * F.col("copies")).alias("n")))
    b = F.col("pair") % BASE
    top = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    out = durable(n.join(F.broadcast(top), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    release(n)
    return out


def scored(found: DataFrame, counts: DataFrame, tier: int = TIER) -> DataFrame:
    """(_key, n_best, count_sum) of every distinct text with tokens."""
    spark = found.sparkSession
    total = counts.count()
    first = counts
    if total > tier:
        cut = counts.select("n").orderBy(F.desc("n")).limit(tier + 1).agg(F.min("n")).first()[0]
        first = counts.where(F.col("n") > cut)  # at most ``tier`` pairs, whatever the ties
    held = first.toArrow()
    order = np.argsort(np.asarray(held["pair"]))
    blob = spark.sparkContext.broadcast((np.asarray(held["pair"])[order], np.asarray(held["n"])[order], np.asarray(held["best"])[order]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = blob.value
        for batch in batches:
            lists = [pa.ListArray.from_arrays(c.offsets, c.values) if isinstance(c, pa.ListArray) else c for c in (batch.column(1), batch.column(2))]
            offs = np.asarray(lists[0].offsets).astype(np.int64)
            at, times = (np.asarray(x.values)[offs[0] : offs[-1]] for x in lists)
            offs = offs - offs[0]
            if not len(pair):
                known, k = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
                got_n = got_best = np.zeros(len(at), np.int64)
            else:
                k = np.minimum(np.searchsorted(pair, at), len(pair) - 1)
                known = pair[k] == at
                got_n, got_best = np.where(known, n[k] * times, 0), np.where(known & best[k], times, 0)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offs])
            rest = np.concatenate([[0], np.cumsum(~known)])[offs].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~known], pa.int64())) for x in (at, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(add(got_best), pa.int64()), pa.array(add(got_n), pa.int64()), *left], ["_key", "n_best", "count_sum", "pairs", "times"])

    near = found.where("n_links > 0").select("_key", "pairs", "times").mapInArrow(task, "_key binary, n_best long, count_sum long, pairs array<long>, times array<long>")
    if total <= tier:
        return near.select("_key", "n_best", "count_sum")
    near = durable(near)
    far = near.select("_key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    far = far.join(counts.where(F.col("n") <= cut), "pair").groupBy("_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return near.select("_key", "n_best", "count_sum").unionByName(far).groupBy("_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def report(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer_a: str = A_MODEL, tokenizer_b: str = B_MODEL, tier: int = TIER) -> DataFrame:
    """One row for each row: the columns of ``keep``, n_a and n_b (tokens), n_groups
    (between places where both sides end), n_links, n_best (links whose pair is,
    over all rows, the most linked of its B id, ties included), count_sum (of the
    links' pairs' counts) and groups_sha256.

    A text that is null, empty or not spelled by both sides has zeros and '';
    repeated rows stay and count as copies; other columns are ignored; an empty
    table gives no rows.
    """
    found = durable(aligned(distinct(docs, text), tokenizer_a, tokenizer_b))
    counts = pair_counts(found)
    measured = found.select("_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scored(found, counts, tier), "_key", "left")
    measured = measured.select("_key", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES), "groups_sha256")
    given = docs.select(*keep, F.col(text).alias("_text"))
    full = given.where(F.col("_text") != "").select(*keep, key(F.col("_text")).alias("_key"))
    none = given.where(F.coalesce(F.col("_text") == "", F.lit(True))).select(*keep, *(F.lit(0).cast("long").alias(c) for c in MEASURES), F.lit("").alias("groups_sha256"))
    return full.join(measured, "_key").select(*keep, *MEASURES, "groups_sha256").unionByName(none)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment measures of every document."""
    return report(table(spark, sf_dir, "documents", "doc_id", "text"))
