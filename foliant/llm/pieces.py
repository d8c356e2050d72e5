"""SentencePiece models: reading, pre-tokens, shared-prefix Viterbi, decoding.

Pre-tokens.  A normalised text is the marked text, each space written as U+2581
with one more in front.  Where no piece holds a mark behind another character or
a line feed beside anything, segmentation never crosses from a pre-token (a run
of marks and what follows it, or a line feed and what follows it) to the next,
so pre-tokens can be segmented one by one and kept.

Shared-prefix Viterbi.  The distinct pre-tokens of a batch are sorted, which is
the depth-first order of their trie; the forward table of the common prefix with
the word before is kept and only the rest is computed.  For a unigram model an
entry is the best score of the prefix and its last piece.  For a BPE model the
sum of scores does not give the library's segmentation; there an entry is the
one last piece the prefix can end in: a piece is admissible after its
predecessor if merging the two pieces' characters by rank gives the two pieces
back, and exactly one admissible piece exists for each prefix.  Both tables are
functions of the prefix alone, which is what makes them shareable.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np

MARK = "▁"
_CHUNK = re.compile("\n[^▁\n]*|▁+[^▁\n]*")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 1_000_000
CACHED_CHARS = 64


def pre_tokens(text: str) -> list[str]:
    """Keys of the pre-tokens of a text, in order; none for an empty text.

    A pre-token of one mark is keyed by what follows the mark, the others by
    NUL and themselves.
    """
    if not text:
        return []
    parts = text.replace("\n", " \n").split(" ") if "\n" in text else text.split(" ")
    if MARK not in text and "\0" not in text and "" not in parts:
        return parts
    marked = MARK + text.replace(" ", MARK)
    return [c[1:] if c[0] == MARK and len(c) > 1 and c[1] not in (MARK, "\0") else "\0" + c for c in _CHUNK.findall(marked)]


def marked(key: str) -> str:
    """The pre-token of a key."""
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else MARK + key


def library_input(key: str) -> tuple[str, int]:
    """A text that the library segments as this pre-token, and how many pieces
    too many that gives (the mark the library puts before a line feed)."""
    chunk = marked(key)
    if chunk[0] == "\n":
        return chunk, 1
    if chunk == MARK:
        return "\n", 1
    return chunk[1:].replace(MARK, " "), 0


def _fields(data: bytes):
    """(field, value) pairs of a protobuf message."""
    i = 0

    def varint(i):
        x = s = 0
        while True:
            x |= (data[i] & 127) << s
            s += 7
            i += 1
            if data[i - 1] < 128:
                return x, i

    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 1:
            v, i = data[i : i + 8], i + 8
        elif kind == 5:
            v, i = data[i : i + 4], i + 4
        else:
            n, i = varint(i)
            v, i = data[i : i + n], i + n
        yield tag >> 3, v


class Model:
    """A SentencePiece model file with identity normalisation."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type = UNIGRAM
        normaliser = {}
        for field, v in _fields(data):
            if field == 1:
                got = dict(_fields(v))
                self.pieces.append(got[1].decode())
                self.scores.append(float(np.frombuffer(got[2], "<f4")[0]) if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif field == 2:
                self.type = dict(_fields(v)).get(3, UNIGRAM)
            elif field == 3:
                normaliser = dict(_fields(v))
        if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with identity normalisation, a dummy prefix and kept white space are read")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        if any(re.search("[^▁]▁|\n", p) and len(p) > 1 for p in self.ids):
            raise ValueError("pieces cross pre-tokens")
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        self.tails = {p[k:]: False for p in self.ids for k in range(len(p))} | dict.fromkeys(self.ids, True)  # of pieces; whether whole
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.unknown_score = min(self.scores) - 10.0
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self._pair = functools.lru_cache(1 << 20)(self._whole)

    def merge(self, text: str) -> list[str]:
        """BPE of a short text by merging the adjacent pair whose union has the
        best score, the leftmost among equals."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        rank = self.rank
        heap = [(rank[t], i, t) for i in range(len(part) - 1) if (t := text[i : i + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, t = heapq.heappop(heap)
            j = after[i] if part[i] is not None else len(part)
            if j >= len(part) or part[i] + part[j] != t:
                continue
            part[i], part[j] = t, None
            after[i] = k = after[j]
            if k < len(part):
                before[k] = i
                if (x := t + part[k]) in rank:
                    heapq.heappush(heap, (rank[x], i, x))
            if (h := before[i]) >= 0 and (x := part[h] + t) in rank:
                heapq.heappush(heap, (rank[x], h, x))
        return [p for p in part if p is not None]

    def _whole(self, left: str, right: str) -> bool:
        return self.merge(left + right) == ([left, right] if left else [right])

    def segment(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each marked pre-token, in the given order.

        The sorted distinct words are walked as a trie; ``last[i]`` is the
        length of the last piece of the prefix of i characters and, for unigram
        models, ``best[i]`` its score.
        """
        got: dict[str, list[int]] = {}
        last, best, prev = [0], [0.0], ""
        ids, rank, pair, tails, bpe = self.ids, self.rank, self._pair, self.tails, self.type == BPE
        for w in sorted(set(words)):
            keep, most = 0, min(len(prev), len(w))
            while keep < most and prev[keep] == w[keep]:
                keep += 1
            del last[keep + 1 :], best[keep + 1 :]
            for i in range(keep + 1, len(w) + 1):
                size, score = 0, 0.0
                at, j = [], i - 1
                while j >= 0 and (whole := tails.get(w[j:i])) is not None:
                    if whole:
                        at.append(j)
                    j -= 1
                for j in reversed(at):
                    if not bpe:
                        s = best[j] - rank[w[j:i]]
                        if not size or s > score:
                            size, score = i - j, s
                    elif pair(w[j - last[j] : j], w[j:i]):
                        size = i - j
                        break
                if not size or not bpe and best[i - 1] + self.unknown_score > score:
                    size, score = 1, best[i - 1] + self.unknown_score
                last.append(size)
                best.append(score)
            prev = w
            out: list[int] = []
            i = len(w)
            while i:
                p = w[i - last[i] : i]
                k = ids.get(p)
                if k is not None:
                    out.append(k)
                elif self.byte:
                    out.extend(self.byte[b] for b in reversed(p.encode("utf-8", "surrogatepass")))
                else:
                    out.append(self.unknown)
                i -= last[i]
            got[w] = out[::-1]
        return [got[w] for w in words]

    def decode(self, ids) -> str:
        """The text of piece ids: the dummy prefix goes, marks become spaces and
        bytes are joined; malformed bytes become U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class Kept:
    """Per-pre-token results kept by a worker, bounded to two generations of
    ``CACHE / 2`` entries; pre-tokens of over ``CACHED_CHARS`` aren't kept."""

    def __init__(self, size: int = CACHE) -> None:
        self.new: dict = {}
        self.old: dict = {}
        self.half = size // 2

    def view(self, keys: list[str], make) -> dict:
        """A mapping that has all of ``keys``; ``make`` gives the values of a
        list of keys that aren't kept."""
        new, old = self.new, self.old
        short: dict = {}
        for k in set(keys).difference(new):
            if k in old:
                new[k] = old[k]
            else:
                short[k] = None
        missing = list(short)
        if not missing:
            return new
        values = make(missing)
        extra = {}
        for k, v in zip(missing, values, strict=True):
            (new if len(k) <= CACHED_CHARS else extra)[k] = v
        view = {**new, **extra} if extra else new
        if len(new) > self.half:
            self.old, self.new = new, {}
        return view


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


@functools.lru_cache(2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def file_of(name: str) -> str:
    """Place of a public vocabulary file; names with a slash are paths already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
