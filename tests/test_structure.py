"""Operators without a query of their own, and the branches that queries don't
reach."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import headings as H
from foliant.operators import paging
from foliant.operators import relations as R
from foliant.operators import repair as P
from foliant.operators import sequences as Q
from foliant.operators import structure as C
from foliant.sources import files


def test_contains_join_for_many_needles(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the harbour wall at dawn"), (2, "a wall"), (3, ""), (4, None)], "id int, text string")
    needles = spark.createDataFrame([("harbour wall",), ("wall",), ("dawn",), ("missing one",), (None,), ("wal",), ("wal",), ("",)], "needle string")
    few = {(r["id"], r["needle"]) for r in R.contains_join(texts, needles, "text", "needle").collect()}
    monkeypatch.setattr(R, "SHARD_CHARS", 8)
    many = [(r["id"], r["needle"]) for r in R.contains_join(texts, needles, "text", "needle").collect()]
    want = {(1, "harbour wall"), (1, "wall"), (1, "dawn"), (2, "wall"), (1, "wal"), (2, "wal"), (1, ""), (2, ""), (3, "")}
    assert set(many) == few == want and len(many) == len(want) + 2  # one needle has two rows


def test_cost_of_range(spark):
    p = spark.createDataFrame([("a", i, "x" * i) for i in range(1, 12)], "novel_id string, n int, text string")
    r = spark.createDataFrame([("a", 2, 4), ("a", 9, 11)], "novel_id string, start int, end int")
    want = {(a, b): sum(i + len(f"\u00b6{i} ") for i in range(a, b + 1)) + b - a for a, b in ((2, 4), (9, 11))}
    assert {(x["start"], x["end"]): x["cost"] for x in H.cost_of_range(p, r).collect()} == want


def test_modes_and_limits(spark):
    n = spark.createDataFrame([("a", "x" * 30_000), ("b", "x" * 30_001)], "novel_id string, text string")
    assert {r["novel_id"]: r["mode"] for r in H.input_mode(n).collect()} == {"a": "full_text", "b": "candidate_evidence"}
    f = spark.createDataFrame([("a", 5001, 0), ("b", 5000, 1200), ("c", 0, 1201)], "novel_id string, strong int, weak int")
    assert {r["novel_id"]: r["fallback"] for r in H.over_limit(f).collect()} == {"a": True, "b": False, "c": True}


@pytest.mark.parametrize("count,want", [(1, [1]), (2, [1, 9]), (3, [1, 5, 9]), (9, list(range(1, 10)))])
def test_even_sample(spark, count, want):
    rows = spark.createDataFrame([("a", i) for i in range(1, 10)], "g string, i int")
    assert sorted(r["i"] for r in Q.even_sample(rows, "g", "i", count).collect()) == want


def test_sample_at_a_cap_of_one(spark):
    c = spark.createDataFrame([("a", i, ["explicit_chapter"]) for i in range(5)], "novel_id string, n int, signals array<string>")
    assert [r["n"] for r in H.sample(c, 1, 1).collect()] == [0]


def test_halving(spark):
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate([10] * 5 + [200] + [10] * 3)], "k string, i int, size int")
    got = {r["i"]: r["b"] for r in paging.halved_blocks(rows, ["k"], "i", "size", 6, 40, "b").collect()}
    # 0-5 has 250: 0-2 fits, 3-5 has 220: 3-4 fits, 5 stands alone; 6-8 fits
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 3, 7: 3, 8: 3}


def test_budget_pick_passes_over(spark):
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate([6, 7, 4, 1])], "k string, i int, size int")
    assert {r["i"]: r["taken"] for r in paging.budget_pick(rows, ["k"], "i", "size", F.lit(10)).collect()} == {0: True, 1: False, 2: True, 3: False}


def test_prepare_rejects_what_is_too_large(spark):
    n = spark.createDataFrame([("a", "one\n\ntwo"), ("b", "x" * 500_001), ("c", None)], "novel_id string, text string")
    fine, rejected = C.prepare(n)
    assert {r["novel_id"]: r["paras"] for r in fine.collect()} == {"a": ["one", "two"], "c": []}
    assert [(r["novel_id"], r["verdict"]) for r in rejected.collect()] == [("b", "chars")]


def test_conflicts_of_changes_stay_open_unless_applied(spark):
    f = spark.createDataFrame([("n", "f1", "k", "a", None)], "novel_id string, id string, key string, value string, superseded_by string")
    c = spark.createDataFrame([("n", "x1", "f1", "f2", "k", "b"), ("n", "x2", "f1", "f3", "other", "c")], "novel_id string, conflict_id string, existing_id string, incoming_id string, key string, value string")
    t = spark.createDataFrame([("n", 1, "f1", "f3"), ("n", 2, "f1", "f2")], "novel_id string, ord int, existing_id string, incoming_id string")
    assert {r["conflict_id"]: (r["status"], r["resolved_by"]) for r in P.apply_state_changes(f, c, t)[1].collect()} == {"x1": ("resolved", "f2"), "x2": ("open", None)}


def test_pages_hold_every_candidate_once(spark):
    rows = [("a", i, "Chapter " + "x" * 100, "chapter", ["explicit_chapter"], 5, 5, [], 1, "before", "after") for i in range(60)]
    c = spark.createDataFrame(rows, "novel_id string, n int, text string, level string, signals array<string>, since int, until int, others array<int>, dup_count int, before string, after string")
    got = C.pages(c, 2000, 100).collect()
    by = {}
    for r in got:
        by.setdefault(r["page"], []).append(r)
    assert sorted(r["n"] for r in got) == list(range(60)) and len(by) > 1
    assert all(sum(len(r["row"]) + 1 for r in v) + 1 <= 1900 for v in by.values())
    assert all("before" not in r["row"] for r in got)
    assert {r["page"] for r in C.pages(c.limit(3), 2000, 100).collect()} == {0}


def test_pasted_texts_and_reports(spark, tmp_path):
    rows = files.pasted(spark, "one", "two\n")
    assert [(r["path"], r["text"]) for r in rows.orderBy("path").collect()] == [("0", "one"), ("1", "two\n")]
    files.write_reports(rows, f"{tmp_path}/reports")
    assert sorted(r["text"] for r in spark.read.json(f"{tmp_path}/reports").collect()) == ["one", "two\n"]
