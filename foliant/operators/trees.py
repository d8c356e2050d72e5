"""Rewriting JSON trees of any depth (K-06).

A text is parsed and brought into VARIANT's form once, where it lies; one pass over
the tokens of that form finds what is to change and writes it, with a stack of the
objects and arrays that are open.  No table of nodes is made, so what moves is a
text and its ranges once, however deep it is.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.batches import small_batches

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s"{}\[\],:]+')
WHOLE = re.compile(r'"?([+-]?\d{1,19})"?')
#: A reference that can be told without its surroundings: nothing before its chunk, whole numbers.
PLAIN = re.compile(r'\{"chunkId":("(?:[^"\\]|\\.)*"),"paragraphRange":\{"end":(-?\d{1,18}),"start":(-?\d{1,18})\}')
CHUNK_KEY = re.compile(r'[{,]"chunkId":')


@lru_cache(1024)
def ranges_of(text: str | None) -> dict[str, list[tuple]]:
    """Each chunk's (start, end, quoted chapter id) in order."""
    by: dict[str, list[tuple]] = {}
    for r in json.loads(text) if text else []:
        by.setdefault(r.get("chunk"), []).append((r.get("start"), r.get("end"), r.get("chapter")))
    return by


def chapter_of(known: list[tuple], start: int, end: int) -> str | None:
    return next((c for lo, hi, c in known if lo is not None and hi is not None and lo <= start and end <= hi), None)


def with_plain(text: str, ranges: dict[str, list[tuple]]) -> str:
    """The text of ``rewritten``; the tokens are gone through only where a
    reference isn't plain."""
    if len(CHUNK_KEY.findall(text)) != len(PLAIN.findall(text)):
        return rewritten(text, ranges)[0]

    def put(m: re.Match) -> str:
        chapter = chapter_of(ranges.get(name_of(m[1]), []), int(m[3]), int(m[2]))
        return m[0] if chapter is None else f'{{"chapterId":{chapter},{m[0][1:]}'

    return PLAIN.sub(put, text)


def name_of(quoted: str) -> str:
    return json.loads(quoted) if "\\" in quoted else quoted[1:-1]


def whole_number(value) -> int | None:
    """The whole number that a scalar's text is."""
    found = WHOLE.fullmatch(value) if isinstance(value, str) else None
    n = int(found[1]) if found else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def rewritten(text: str, ranges: dict[str, list[tuple]]) -> tuple[str, list[tuple[str, str]]]:
    """A tree in VARIANT's form with the chapters of its references set, and (path,
    rule) of the references that have none.
    ``ranges`` has each chunk's (start, end, quoted chapter id) in order."""
    bad: list[tuple[str, str]] = []
    opened: list[list] = []  # [is an object, entries (name, quoted, value), place in what holds it, quoted name of the entry at hand]
    root = None
    for token in TOKEN.finditer(text):
        t = token[0]
        if t == "," or t == ":":
            continue
        if t == "{" or t == "[":
            opened.append([t == "{", [], len(opened[-1][1]) if opened else 0, None])
            continue
        value = t
        if t == "}" or t == "]":
            node = opened[-1]
            if node[0]:
                if rule := placed(node[1], ranges):
                    bad.append(("".join(f"/{n[2]}" for n in opened[1:]), rule))
            opened.pop()
            value = (node[0], node[1])
        elif opened and opened[-1][0] and opened[-1][3] is None:
            opened[-1][3] = t
            continue
        if not opened:
            root = value
            continue
        into = opened[-1]
        into[1].append((name_of(into[3]), into[3], value) if into[0] else (None, None, value))
        into[3] = None
    out: list[str] = []
    todo = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        is_object, entries = x
        out.append("{" if is_object else "[")
        todo.append("}" if is_object else "]")
        for i in range(len(entries) - 1, -1, -1):
            _, quoted, value = entries[i]
            todo.append(value)
            if head := ("," if i else "") + (f"{quoted}:" if is_object else ""):
                todo.append(head)
    return "".join(out), bad


def placed(entries: list[tuple], ranges: dict[str, list[tuple]]) -> str | None:
    """Sets the chapter among an object's entries if it is a reference, an object
    with a text chunkId and an object paragraphRange; the rule it breaks if it has
    none."""
    by = {name: value for name, _, value in entries}
    chunk, span = by.get("chunkId"), by.get("paragraphRange")
    if not (isinstance(chunk, str) and chunk.startswith('"') and isinstance(span, tuple) and span[0]):
        return None
    known = ranges.get(name_of(chunk))
    if known is None:
        return "chunk_unknown"
    number = {name: whole_number(value) for name, _, value in span[1]}
    start, end = number.get("start"), number.get("end")
    if start is None or end is None:
        return "range_invalid"
    chapter = chapter_of(known, start, end)
    if chapter is None:
        return "range_crosses"
    entries[:] = [e for e in entries if e[0] != "chapterId"]
    at = next(i for i, e in enumerate(entries) if e[0] > "chapterId")
    entries.insert(at, ("chapterId", '"chapterId"', chapter))
    return None


def with_chapters(docs: DataFrame, ranges: DataFrame, key: str = "id", json: str = "json") -> tuple[DataFrame, DataFrame]:
    """K-06: ((id, json), (id, path, rule)): ``docs`` with chapterId set in every
    reference, at any depth, to the chapter whose range (id, chunk_id, chapter_id,
    start, end) holds it; and the references that have none: of another chunk
    (chunk_unknown), without whole numbers (range_invalid), or across or outside
    the chapters (range_crosses).  Of several chapters that hold one the first
    counts.  A document that is no JSON has no row."""
    small_batches(docs.sparkSession)
    quoted = F.to_json(F.struct(F.col("chapter_id").alias("k")))
    quoted = F.when(F.col("chapter_id").isNotNull(), quoted.substr(F.lit(6), F.length(quoted) - 6))
    one = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), quoted.alias("chapter"), F.col("chunk_id").alias("chunk"))
    held = ranges.groupBy(F.col("id").alias("_id")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("_r"))

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([with_plain(t, ranges_of(r)) for t, r in zip(texts, held, strict=True)], dtype=object)

    @F.pandas_udf("array<struct<path:string,rule:string>>")
    def broken(texts: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "rule": x} for p, x in rewritten(t, ranges_of(r))[1]] for t, r in zip(texts, held, strict=True)], dtype=object)

    rows = docs.select(F.col(key).alias("id"), F.to_json(F.try_parse_json(json)).alias("_text")).where("_text is not null").join(held, F.col("id") == F.col("_id"), "left")
    bad = rows.select("id", F.explode(broken("_text", "_r")).alias("_b")).select("id", "_b.path", "_b.rule")
    return rows.select("id", rewrite("_text", "_r").alias("json")), bad
