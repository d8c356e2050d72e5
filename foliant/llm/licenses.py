"""Operator 12: licence scans.

An Aho-Corasick automaton over words finds identifier tags and notice phrases
in one pass; what follows a tag is read as a licence expression and evaluated by
a shunting-yard parser.  Words are looked up in the automaton's vocabulary by
hash, all of a batch at once, and only runs of vocabulary words are walked; every
match is compared with the text, so a clash of hashes adds nothing.  Map-side
only: no shuffle, and nothing is kept from one text to the next.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, table
from foliant.llm.textkit import Words, column, slices

#: The base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method with their labels.
NOTICES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "confidential and proprietary": "proprietary",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "unauthorized copying of this file": "proprietary",
}
#: Words after which a licence expression stands, behind a colon or equals sign.
TAGS = ("license expression", "licenseinfoinfile", "packagelicenseconcluded", "packagelicensedeclared", "spdx license identifier")
#: How much a licence asks of whoever takes the text, by the longest prefix of its name.
LEVELS = {"0bsd": 0.1, "agpl": 0.8, "apache": 0.25, "bsd": 0.2, "bsl": 0.2, "cc-by": 0.3, "cc-by-nc": 0.85, "cc-by-nd": 0.85, "cc-by-sa": 0.5, "cc0": 0.1, "cddl": 0.5, "epl": 0.5, "gpl": 0.75, "isc": 0.2, "lgpl": 0.5, "mit": 0.2, "mpl": 0.5, "proprietary": 1.0, "public-domain": 0.1, "reserved": 1.0, "unlicense": 0.1, "zlib": 0.2}
UNKNOWN, RELIEVED = 0.9, 0.5
#: Binding strength of the operators.
OPERATORS = {"or": 1, "and": 2, "with": 3}

#: Bytes that part words here as spaces, others as they are.
_PARTED = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PARTED[_a:_b] = np.arange(_a, _b)
_TOKEN = re.compile(r"[ \t]*([A-Za-z0-9][A-Za-z0-9.+:-]*|[()])")
_OPENING = re.compile("[ \t]*[\"']?[ \t]*[:=][ \t\"']*")


def level(name: str) -> float:
    """The level of a licence's name; 0.9 for one that is not known."""
    for n in range(len(name), 0, -1):
        if name[:n] in LEVELS:
            return LEVELS[name[:n]]
    return UNKNOWN


def evaluate(text: str) -> tuple[float, frozenset[str], bool] | None:
    """(level, licence names, well-formed) of the expression that ``text`` begins
    with; None if it begins with none.

    Of alternatives (or) the lower level counts, of licences that hold together
    (and) the higher; an exception (with) takes a copyleft licence down to 0.5.
    ``with`` binds closest, then ``and``, equal ones to the left.  The expression
    ends before anything that can't continue it; an operator without a right side
    is dropped and an open bracket closed, and the expression is then not
    well-formed.
    """
    return parse(text)[0]


def parse(text: str) -> tuple[tuple[float, frozenset[str], bool] | None, bool]:
    """What ``evaluate`` gives, and whether more text could change it."""
    values: list[tuple[float, frozenset[str]]] = []
    waiting: list[str] = []

    def apply() -> None:
        what, right, left = waiting.pop(), values.pop(), values.pop()
        if what == "with":
            values.append((min(left[0], RELIEVED) if left[0] < UNKNOWN else left[0], left[1]))
        else:
            values.append(((min if what == "or" else max)(left[0], right[0]), left[1] | right[1]))

    at, operand, depth = 0, False, 0
    while m := _TOKEN.match(text, at):
        token = m[1].lower()
        if operand and token in OPERATORS:
            while waiting and waiting[-1] != "(" and OPERATORS[waiting[-1]] >= OPERATORS[token]:
                apply()
            waiting.append(token)
            operand = False
        elif operand and token == ")" and depth:
            while waiting[-1] != "(":
                apply()
            waiting.pop()
            depth -= 1
        elif not operand and token == "(" and waiting[-1:] != ["with"]:
            waiting.append("(")
            depth += 1
        elif not operand and token not in OPERATORS and token not in ("(", ")"):
            token = token.rstrip(".:")
            values.append((level(token), frozenset([token])))
            operand = True
        else:
            break
        at = m.end()
    touched = (m.end() if m else at + len(text[at:]) - len(text[at:].lstrip(" \t"))) == len(text)
    good = operand and not depth
    while waiting:
        if waiting[-1] != "(" and operand:
            apply()
        elif waiting.pop() != "(":  # an operator without a right side
            operand = True
    return (*values[-1], good) if values else None, touched


class Automaton:
    """Aho-Corasick over word numbers: a trie of phrases whose states know the
    longest proper suffix that is a state too, and all phrases that end there."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = [p.split() for p in phrases]
        self.words = sorted({w for p in self.phrases for w in p})
        number = {w: k for k, w in enumerate(self.words)}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, p in enumerate(self.phrases):
            s = 0
            for k in map(number.__getitem__, p):
                if k not in self.next[s]:
                    self.next[s][k] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                s = self.next[s][k]
            self.ends[s].append(i)
        self.back = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            s = todo.popleft()
            self.ends[s] = self.ends[s] + self.ends[self.back[s]]
            for k, t in self.next[s].items():
                self.back[t] = self.step(self.back[s], k)
                todo.append(t)
        text = np.frombuffer(" ".join(self.words).encode(), np.uint8)
        hashes = Words(text, np.array([0, len(text)])).hash
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def step(self, s: int, k: int) -> int:
        while s and k not in self.next[s]:
            s = self.back[s]
        return self.next[s].get(k, 0)

    def find(self, words: Words) -> Iterator[tuple[int, int]]:
        """(phrase, number of its first word) of all places in a run of texts,
        also of phrases inside others; none crosses from one text to the next."""
        k = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[k] == words.hash)
        s, last = 0, -2
        for i, number in zip(at.tolist(), self.order[k[at]].tolist(), strict=True):
            s = self.step(s if i == last + 1 else 0, number)
            last = i
            for p in self.ends[s]:
                first = i + 1 - len(self.phrases[p])
                row = np.searchsorted(words.first, first, "right") - 1
                if i < words.first[row + 1] and all(bytes(words.data[words.start[first + j] : words.end[first + j]]).lower() == w.encode() for j, w in enumerate(self.phrases[p])):
                    yield p, first


@lru_cache(1)
def automaton() -> tuple[Automaton, list[tuple[str, str]]]:
    """The automaton and the (kind, label) of each of its phrases."""
    what = [*((p, "base", x) for p, x in BASE.items()), *((p, "notice", x) for p, x in NOTICES.items()), *((p, "tag", "") for p in TAGS)]
    return Automaton([p for p, _, _ in what]), [(kind, label) for _, kind, label in what]


def scan(words: Words, data: np.ndarray) -> Iterator[tuple[int, str, str, int, int, float, bool]]:
    """(row, kind, labels, first word, words, level, well-formed) of everything
    found in a run of texts, of which ``data`` are the bytes; labels of an expression
    are comma-joined."""
    search, what = automaton()
    for p, first in search.find(words):
        kind, label = what[p]
        row = int(np.searchsorted(words.first, first, "right") - 1)
        n = len(search.phrases[p])
        if kind != "tag":
            yield row, kind, label, first - int(words.first[row]), n, level(label), True
            continue
        if got := behind(data, int(words.end[first + n - 1]), int(words.offs[row + 1])):
            yield row, kind, ",".join(sorted(got[1])), first - int(words.first[row]), n, got[0], got[2]


def behind(data: np.ndarray, a: int, b: int) -> tuple[float, frozenset[str], bool] | None:
    """The expression on the rest of the line behind a tag that ends at byte
    ``a`` of a text that ends at ``b``; only as much is looked at as it takes."""
    size = 256
    while True:
        line, *more = bytes(data[a : min(a + size, b)]).split(b"\n", 1)
        text = line.decode("utf-8", "replace")
        m = _OPENING.match(text)
        got, open_ = parse(text[m.end() :]) if m else (None, not text.strip(" \t\"'"))
        if more or a + size >= b or not open_:
            return got
        size *= 4


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, np.ndarray]]:
    """(number of the first row, words, bytes) of runs of a batch's texts."""
    for lo, _, data, offs in slices(column(batch, "_text")):
        yield lo, Words(_PARTED[data], offs), data


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each finding: the columns of ``keep``, kind (base, notice or
    tag), labels, first_word (from 0), words, level and well_formed.

    Null and empty texts have none; repeated rows each have theirs; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    names = ["kind", "labels", "first_word", "words", "level", "well_formed"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(lo + x[0], *x[1:]) for lo, words, data in runs(batch) for x in scan(words, data)]
            if got:
                rows, *cols = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[: len(keep)]), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*keep, *names])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(task, f"{fields}, kind string, labels string, first_word long, words long, level double, well_formed boolean")


def report(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each text: the columns of ``keep``, n_words, n_base (places of
    base phrases), first_word and last_word (smallest and largest start of these,
    null without any), base_labels and labels (distinct, sorted, comma-joined; ''
    without any) and score, the highest level found, 0 without any.

    A finding inside a longer one keeps its label but not its level ("lesser
    general public license" is lgpl and gpl, with the level of lgpl).  Null texts
    are empty; repeated rows stay; other columns are ignored; an empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def one(n: int, found: list) -> tuple:
        base = [x for x in found if x[1] == "base"]
        labels = {y for x in found for y in x[2].split(",")}
        starts = [x[3] for x in base]
        return n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[2] for x in base})), ",".join(sorted(labels)), max((x[5] for x in outer(found)), default=0.0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, words, data in runs(batch):
                by: dict[int, list] = {}
                for x in scan(words, data):
                    by.setdefault(x[0], []).append(x)
                out += [one(n, by[i]) if i in by else (n, 0, None, None, "", "", 0.0) for i, n in enumerate(words.count.tolist())]
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*keep, *names])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(task, f"{fields}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def outer(found: list) -> list:
    """The findings that lie in no longer one, in one pass by start."""
    out, reach = [], -1
    for x in sorted(found, key=lambda x: (x[3], -x[4])):
        if x[3] + x[4] > reach or (out and (x[3], x[4]) == (out[-1][3], out[-1][4])):
            out.append(x)
            reach = max(reach, x[3] + x[4])
    return out


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and score of every document."""
    return report(table(spark, sf_dir, "documents", "doc_id", "text"))
