"""The methods themselves: DivideSkip's division and skipping, word-first backoff."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import jaccard_join, language_id


def near_copies(seed, n, m, change):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 2**62, m)
    out = []
    for _ in range(n):
        x = base.copy()
        k = rng.random(m) < rng.random() * change
        x[k] = rng.integers(1, 2**62, k.sum())
        out.append(np.unique(x.astype(np.uint64)))
    return out


@pytest.mark.parametrize("mu", [1e-12, 0.002, 0.0085, 0.1])
@pytest.mark.parametrize("seed", range(3))
def test_divide_skip_finds_what_brute_force_finds(monkeypatch, mu, seed):
    sets = near_copies(seed, 60, 400, 0.3) + near_copies(seed + 9, 20, 30, 0.4)
    asked, merge = [], jaccard_join.merge_skip
    monkeypatch.setattr(jaccard_join, "merge_skip", lambda lists, t: asked.append(t) or merge(lists, t))
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                up[root(i)] = root(j)
    want = Counter(root(i) for i in range(len(sets)))
    got = list(range(len(sets)))

    def top(i):
        while got[i] != i:
            i = got[i]
        return i

    for a, b in jaccard_join.t_occurrence(sets, np.arange(len(sets)), np.ones(len(sets), bool), mu=mu):
        got[top(a)] = top(b)
    assert sorted(Counter(top(i) for i in range(len(sets))).values()) == sorted(want.values())
    assert all(top(i) == top(j) for i in range(len(sets)) for j in range(len(sets)) if root(i) == root(j))
    assert (max(asked) > 1) == (mu > 1e-6)  # heads are skipped wherever lists are divided by cost


def test_lists_are_divided_as_documented():
    assert jaccard_join.divided(857, 1024) == int(857 / (jaccard_join.MU * 10 + 1)) < 857
    assert jaccard_join.divided(1, 50) == 0 and jaccard_join.divided(10, 1) == 9


def test_merge_skips_entries():
    lists = [list(range(k, 40_000, 3 + k % 2)) for k in range(11)] + [[5, 900, 901, 20_000, 39_990]]
    for t in (1, 3, 6, 9):
        seen = Counter(x for line in lists for x in line)
        read = []

        class Watched(list):
            def __getitem__(self, i):
                read.append(i)
                return super().__getitem__(i)

        some = lists if t < 9 else [*lists[:3], *(x[::400] for x in lists[3:])]
        seen = Counter(x for line in some for x in line)
        assert dict(jaccard_join.merge_skip([Watched(x) for x in some], t)) == {x: n for x, n in seen.items() if n >= t}
        if t == 9:
            assert len(read) < sum(map(len, some)) / 2


def plain_score(rows, langs, word):
    """The backoff, spelled out: the word, else the longest n-grams of which one is known."""
    total = {(lang, size): t for lang, size, _, _, t in rows}
    n_of = {(lang, size, e): n for lang, size, e, n, _ in rows}
    known = lambda size, e: any((x, size, e) in n_of for x in langs)
    value = lambda x, size, e: math.log((n_of[x, size, e] + 0.5) / (total[x, size] + 1)) if (x, size, e) in n_of else math.log(0.5 / (total.get((x, size), 0) + 1))
    if known(0, word):
        return [value(x, 0, word) for x in langs]
    for n in range(min(language_id.LONGEST, len(word) + 2), 0, -1):
        w = f"<{word}>" if n > 1 else word
        grams = [w[i : i + n] for i in range(len(w) - n + 1) if known(n, w[i : i + n])]
        if grams:
            return [sum(value(x, n, g) for g in grams) / len(grams) for x in langs]
    return [0.0] * len(langs)


def test_backoff_order_by_brute_force():
    rng = random.Random(4)
    rows = []
    for lang in ("de", "en", "fr"):
        for size in range(language_id.LONGEST + 1):
            entries = {"".join(rng.choice("abc<>" if size > 1 else "abc") for _ in range(size or rng.randint(1, 5))) for _ in range(6)}
            rows += [(lang, size, e, rng.randint(1, 9), 60) for e in entries]
    model = language_id.model_of([dict(zip(("lang", "size", "entry", "n", "total"), r, strict=True)) for r in rows])
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(400)] + [r[2] for r in rows if r[1] == 0] + ["zzz"]
    for w in words:
        assert np.allclose(language_id.score_word(model, w), plain_score(rows, model["langs"], w))
    model = language_id.ready(model)
    assert model["full"] and all(np.allclose(language_id.score_word(model, w), plain_score(rows, model["langs"], w)) for w in words)


def test_model_is_bounded_over_languages():
    assert language_id.quotas(4) == (language_id.WORDS, language_id.GRAMS)
    for n in (20, 100, 5000):
        words, grams = language_id.quotas(n)
        assert n * (words + language_id.LONGEST * grams) * language_id.ENTRY_BYTES <= language_id.MODEL_BYTES + n * 6 * language_id.ENTRY_BYTES


def test_equal_scores_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "alpha beta", "xx"), (2, "alpha beta", "aa"), (3, "gamma", "mm")], "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, model).collect()}
    assert got[1] == got[2] == "aa" and got[3] == "mm"
