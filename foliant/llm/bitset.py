"""A blocked Bloom filter of fixed maximal size, built by executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 1 << 16
MAX_BLOCKS = 4096
PER_KEY = 12
PROBES = 3


class Filter:
    """Membership of 64-bit keys: no false negatives; false positives grow with
    the fill, the size doesn't (at most MAX_BLOCKS * BLOCK_BITS bits)."""

    def __init__(self, blocks: int, bits: np.ndarray) -> None:
        self.blocks, self.bits = blocks, bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not self.blocks:
            return np.zeros(len(keys), bool)
        at, found = _block(keys, self.blocks) * (BLOCK_BITS // 8), np.ones(len(keys), bool)
        for p in _probes(keys):
            found &= (self.bits[at + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
        return found


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)


def _probes(keys: np.ndarray):
    for k in range(PROBES):
        yield ((keys >> np.uint64(13 * k)) % np.uint64(BLOCK_BITS)).astype(np.int64)


def block_of(key: Column, blocks: int) -> Column:
    return (F.shiftrightunsigned(key, 40) % blocks).cast("int")


def build(keys: DataFrame, column: str, n: int) -> Filter:
    """The filter of a long column of ``n`` distinct keys.  Each block of 8 kB is
    made by one task from the keys that fall in it, so the driver receives the
    finished bits only."""
    blocks = int(min(MAX_BLOCKS, -(-n * PER_KEY // BLOCK_BITS)))
    if not blocks:
        return Filter(0, np.zeros(0, np.uint8))

    def task(frames):
        held: dict[int, np.ndarray] = {}
        for pdf in frames:
            k = pdf["k"].to_numpy(np.int64).view(np.uint64)
            which = _block(k, blocks)
            order = np.argsort(which, kind="stable")
            k, which = k[order], which[order]
            cuts = np.flatnonzero(np.diff(which)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(k)], strict=True):
                bits = held.setdefault(int(which[a]), np.zeros(BLOCK_BITS, bool)) if b > a else None
                for p in _probes(k[a:b]):
                    bits[p] = True
        if held:
            yield pd.DataFrame({"block": list(held), "bits": [np.packbits(v, bitorder="little").tobytes() for v in held.values()]})

    dealt = keys.select(F.col(column).alias("k")).withColumn("g", block_of(F.col("k"), blocks))
    bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
    for r in dealt.repartition("g").select("k").mapInPandas(task, "block int, bits binary").toLocalIterator():
        at = r["block"] * (BLOCK_BITS // 8)
        bits[at : at + BLOCK_BITS // 8] |= np.frombuffer(r["bits"], np.uint8)
    return Filter(blocks, bits)
