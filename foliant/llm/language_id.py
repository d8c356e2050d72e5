"""Operator 5: language identification with word-first backoff.

A known word scores its log frequency in each language.  A word the model has
not kept falls back to its character n-grams of the longest length at which any
of them is known, then to shorter ones.  Both tables are fitted on a sample of
about SAMPLE training documents of each language and keep the WORDS and GRAMS most frequent
entries of each language, fewer where the languages are so many that these would
take over MODEL_BYTES.  An entry holds the languages that know it and their
values only; the others have one default for each length.  So the model that is
collected and broadcast is bounded, however many languages there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import crc_mod, durable, hash_sample, release, small_batches, table
from foliant.llm.pieces import Kept

SAMPLE = 2_000
WORDS = 20_000
GRAMS = 4_000
LONGEST = 5
SHARPNESS = 0.5
#: Size of the model, at ENTRY_BYTES for an entry of one language with its place in the tables.
MODEL_BYTES, ENTRY_BYTES = 256 << 20, 400
#: Up to so many languages a worker holds the values of an entry in full.
DENSE = 32
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between two boundary marks."""
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def train(docs: DataFrame, chosen: Column, sample: int = SAMPLE) -> dict:
    """Fits on the rows of ``docs`` (doc_id, text, lang) where ``chosen`` holds
    and lang is not null: of each language the about ``sample`` with the lowest
    hash of id, so that a rare language is learned from all it has.  Empty, blank
    and repeated texts are as good as others; without rows nothing is learned.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(chosen & F.col("lang").isNotNull() & F.col("text").isNotNull())
    few = hash_sample(rows.select("doc_id", "lang", "text"), sample, "doc_id", "lang").select("lang", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, 0, w, n) for lang, c in held.items() for w, n in c.items()]
        for lang, c in held.items():
            g: Counter = Counter()
            for w, n in c.items():
                for k in range(1, LONGEST + 1):
                    for x in grams(w, k):
                        g[k, x] += n
            rows += [(lang, k, x, n) for (k, x), n in g.items()]
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["lang", "size", "entry", "n"]), preserve_index=False)

    counts = few.mapInArrow(task, "lang string, size long, entry string, n long")
    counts = counts.groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    w = W.partitionBy("lang", "size")
    counts = counts.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "entry")))
    counts = durable(counts)
    words, few_grams = quotas(counts.select("lang").distinct().count())
    kept = counts.where(F.col("rank") <= F.when(F.col("size") == 0, words).otherwise(few_grams)).select("lang", "size", "entry", "n", "total").collect()
    release(counts)
    return model_of(kept)


def quotas(langs: int, size: int = MODEL_BYTES) -> tuple[int, int]:
    """Words, and n-grams of each length, that a language may keep."""
    share = min(1.0, size / ENTRY_BYTES / max(langs, 1) / (WORDS + LONGEST * GRAMS))
    return max(1, int(WORDS * share)), max(1, int(GRAMS * share))


def model_of(kept: list) -> dict:
    """The model of rows (lang, size, entry, n, total): langs, for each size the
    default of every language, and tables of entries to (places of the languages
    that know it, their values)."""
    langs = sorted({r["lang"] for r in kept})
    at = {x: i for i, x in enumerate(langs)}
    total = {(r["lang"], r["size"]): r["total"] for r in kept}
    default = [np.array([math.log(0.5 / (total.get((x, k), 0) + 1)) for x in langs]) for k in range(LONGEST + 1)]
    held: list[dict[str, list]] = [{} for _ in range(LONGEST + 1)]
    for r in kept:
        held[r["size"]].setdefault(r["entry"], []).append((at[r["lang"]], math.log((r["n"] + 0.5) / (r["total"] + 1))))
    tables = [{e: (np.array([i for i, _ in x], np.int32), np.array([v for _, v in x])) for e, x in t.items()} for t in held]
    return {"langs": langs, "default": default, "tables": tables}


def full(model: dict, entry: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """The values of an entry in all languages."""
    out = model["default"][size].copy()
    out[entry[0]] = entry[1]
    return out


def ready(model: dict) -> dict:
    """The model with its entries in full, made once in a worker, where the
    languages are so few (DENSE) that this takes no more than the bound."""
    if len(model["langs"]) <= DENSE and not model.get("full"):
        model["tables"] = [{e: full(model, x, k) for e, x in t.items()} for k, t in enumerate(model["tables"])]
        model["full"] = True
    return model


def score_word(model: dict, word: str) -> np.ndarray:
    """Log score of a word in each language."""
    tables = model["tables"]
    whole = (lambda x, n: x) if model.get("full") else (lambda x, n: full(model, x, n))
    if (v := tables[0].get(word)) is not None:
        return whole(v, 0)
    for n in range(min(LONGEST, len(word) + 2), 0, -1):
        table = tables[n]
        known = [v for x in grams(word, n) if (v := table.get(x)) is not None]
        if known:
            return np.mean([whole(v, n) for v in known], axis=0)
    return np.zeros(len(model["langs"]))


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Language of every whole text, from the text alone.

    Returns the columns of ``keep``, lang_pred and score, the share of the
    predicted language in the softmax of the summed word scores, tempered by the
    square root of the number of words.  A null text, or one without a letter, is
    ``und`` with score 0, as is every text if nothing was learned.  Equal scores
    go to the first language by code point.
    """
    small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kept = ready(spread.value), Kept(200_000)
        langs = m["langs"]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [words_of(t or "") for t in batch.column(len(keep)).to_pylist()]
                counts = [Counter(t) for t in texts]
                view = kept.view([w for c in counts for w in c], lambda ws: [score_word(m, w) for w in ws])
                names, scores = [], []
                for c in counts:
                    if not langs or not any(ch.isalpha() for w in c for ch in w):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    n = np.fromiter(c.values(), float, len(c))
                    s = n @ np.array([view[w] for w in c])
                    s = (s - s.max()) * SHARPNESS / math.sqrt(n.sum())
                    p = np.exp(s)
                    best = int(np.argmax(s))
                    names.append(langs[best])
                    scores.append(float(p[best] / p.sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(task, f"{fields}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = crc_mod(F.col("doc_id"), 3) == 1
    model = train(docs, ~out)
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
