"""Vectorised byte-level text scanning shared by the Arrow-batch operators.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  All white space
of that class is ASCII, so words can be found on UTF-8 bytes directly, and a
batch of texts is scanned with a handful of numpy passes instead of a Python
loop over words.  Word and shingle identities are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
SHINGLE = 5

_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))
_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, m in enumerate((_MUL, _INV)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) over runs of rows of about
    ``limit`` bytes; one longer text makes a run of its own.  Null is empty."""
    if not pa.types.is_large_string(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may span bytes
        gone = np.asarray(texts.is_null())
        size = np.where(gone, 0, np.diff(offs))
        if size.sum() != offs[-1] - offs[0]:
            data = b"".join(x or b"" for x in texts.cast(pa.large_binary()).to_pylist())
            data, offs = np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Words:
    """The words of a run of texts: byte spans, owning row, hash.

    ``first[i]:first[i+1]`` are the words of row i.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True, hashed: bool = True) -> None:
        self.data, self.offs = data, offs
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.ones(n, bool)
        if n:
            before[1:] = ~solid[:-1]
            before |= edge[:-1]
        after = np.ones(n, bool)
        if n:
            after[:-1] = ~solid[1:]
            after |= edge[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.solid = solid
        if hashed:
            p, inv = _powers(n + 1)
            self._cum = np.zeros(n + 1, np.uint64)
            np.cumsum(_CODE[_LOWER[data] if lower else data] * p[:n], out=self._cum[1:])
            self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans, equal for equal bytes."""
        _, inv = _powers(len(self.data) + 1)
        return mix((self._cum[end] - self._cum[start]) * inv[start] + (end - start).astype(np.uint64))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window of ``width`` words
        that lies within one text."""
        w = self.hash
        if len(w) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.first[1:], self.count) - np.arange(len(w))
        at = np.flatnonzero(left >= width)
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            out = out * _MUL + w[at + k]
        return at, mix(out)


def shingle_sets(words: Words, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than
    ``width`` words has its whole word sequence as one, none without words."""
    at, h = words.windows(width)
    cut = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.count):
        if n >= width:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif n:
            x = np.uint64(n)
            for v in words.hash[words.first[i] : words.first[i + 1]]:
                x = mix(np.array([x], np.uint64) * _MUL + v)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
