import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import segment as S


def pack(spark, paras, target, overlap, starts=None, hints=None):
    df = spark.createDataFrame([("n", paras, starts, hints)], "novel_id string, paras array<string>, starts array<int>, hints array<int>")
    return S.chunks(df, target, overlap, starts="starts", hints="hints").orderBy("idx").collect()


def cores(rows):
    return [(r["start"], r["end"]) for r in rows]


def test_packing_by_hand(spark):
    assert cores(pack(spark, ["第一章", "一" * 6, "第二章", "二" * 6, "第三章", "三" * 6], 33, 0, [1, 3, 5])) == [(1, 4), (5, 6)]
    assert cores(pack(spark, ["甲" * 6] * 3, 19, 0)) == [(1, 2), (3, 3)]
    rows = pack(spark, ["甲" * 4] * 5, 15, 7)
    assert cores(rows) == [(1, 2), (3, 4), (5, 5)]
    r = rows[1]
    assert (r["before"], r["after"], r["core_chars"], r["context_chars"]) == (2, 5, 15, 31)


def test_three_chapters(spark):
    rows = pack(spark, ["第一章", "甲甲甲甲", "第二章", "乙乙乙乙", "第三章", "丙丙丙丙"], 14, 7, [1, 3, 5])
    assert cores(rows) == [(1, 2), (3, 4), (5, 6)] and [r["core_chars"] for r in rows] == [14, 14, 14]
    assert (rows[1]["before"], rows[1]["after"]) == (2, 5)


def test_hints_cut_a_long_chapter(spark):
    assert cores(pack(spark, ["第一章", "甲甲甲", "节", "乙乙乙乙乙", "节", "丙丙丙丙丙"], 17, 0, [1], [3, 5])) == [(1, 2), (3, 4), (5, 6)]


def test_headings(spark):
    yes = ["第十二章 初雪", "第3回", "一、山里的木匠", "序章", "番外：旧事", "Chapter 7 Harbour"]
    no = ["1．工具：三把。", "5．天气：有雾，午后转晴", "12. 这条小路走了许多年。", "第一章" + "长" * 90]
    rows = spark.createDataFrame([(t,) for t in yes + no], "text string").select("text", S.is_chapter(F.col("text")).alias("c")).collect()
    assert {r["text"]: r["c"] for r in rows} == {**dict.fromkeys(yes, True), **dict.fromkeys(no, False)}


def test_chapters(spark):
    lines = ["书名页", "第一章 初雪", "第一章正文", "Chapter 2 The Orchard", "第二章正文"]
    df = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(lines)] + [("b", 1, "甲"), ("b", 2, "乙")], "novel_id string, n int, text string")
    got = [(r["novel_id"], r["title"], r["start"], r["end"]) for r in S.chapters(df).orderBy("novel_id", "idx").collect()]
    assert got == [("a", "开篇", 1, 1), ("a", "第一章 初雪", 2, 3), ("a", "Chapter 2 The Orchard", 4, 5), ("b", "正文", 1, 2)]


@pytest.mark.parametrize("target,overlap", [(127, 23), (1000, 0), (300, 100)])
def test_invariants(spark, target, overlap):
    text = "River渡口边⛵️" * 41 + "\r\n" + "Stone石桥🌉" * 37 + "\n" + "。".join("甲" * (k % 50) for k in range(200))
    novels = spark.createDataFrame([("n", text)], "novel_id string, text string")
    from foliant.functions.text import lines

    cut = S.split_oversized(novels.select("novel_id", lines(F.col("text")).alias("paras")), target, overlap)
    paras = cut.first()["paras"]
    assert "".join("".join(paras).split()) == "".join(text.split())
    rows = S.chunks(cut, target, overlap).orderBy("idx").collect()
    at = 1
    for r in rows:
        assert r["start"] == at and r["core_chars"] <= target and r["context_chars"] <= target + 2 * overlap + 2
        at = r["end"] + 1
    assert at == len(paras) + 1
    n = cut.select("novel_id", F.size("paras").alias("n_paragraphs"))
    assert S.coverage_violations(S.chunks(cut, target, overlap), n, target).count() == 0


@pytest.fixture(scope="module")
def warm(spark):
    pack(spark, ["甲"] * 10, 25_000, 800)


def test_many_short_lines(spark, warm):
    began = time.time()
    assert len(pack(spark, ["甲"] * 100_000, 25_000, 800)) > 4
    assert time.time() - began < 10


def test_largest_text(spark, warm):
    """10 MiB from lines to chunks."""
    from foliant.functions.text import lines

    line = "x" * 255
    df = spark.createDataFrame([("n", "\n".join([line] * (10 * 1024 * 1024 // 256)))], "novel_id string, text string")
    began = time.time()
    assert S.chunks(S.split_oversized(df.select("novel_id", lines(F.col("text")).alias("paras")))).count() > 400
    assert time.time() - began < 10


def test_splits():
    pieces = S.split_by_budget("字" * 100_000, 10_000)
    assert len(pieces) == 10 and "".join(pieces) == "字" * 100_000
    assert S.split_by_budget("一句。两句！三", 4) == ["一句。", "两句！三"]


def test_rejects_bad_budgets():
    for bad in ((0, 0), (10, -1), (1.5, 0)):
        with pytest.raises(ValueError):
            S.check_budgets(*bad)


def test_empty_and_null(spark):
    df = spark.createDataFrame([("a", []), ("b", None)], "novel_id string, paras array<string>")
    assert S.chunks(df, 10, 0).count() == 0


def test_greedy_bins(spark):
    df = spark.createDataFrame([([1000] * 4,), ([4000, 500],), ([],)], "s array<int>")
    assert [r[0] for r in df.select(S.greedy_bins(F.col("s"), 2500)).collect()] == [[0, 0, 1, 1], [0, 1], []]


def test_search_of_many_needles():
    import random

    from foliant.operators.relations import Search

    rng = random.Random(1)
    letters = "ab é漢😀"
    word = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    for _ in range(60):
        texts = [word(0, 400) for _ in range(6)]
        needles = list({*(word(0, 5) for _ in range(30)), *(t[i : i + n] for t in texts for i, n in ((3, 20), (9, 70), (0, 130), (50, 400)))})
        search = Search(needles)
        assert [search.find(t) for t in texts] == [sorted(n for n in needles if n in t) for t in texts]
    assert Search([]).find("x") == [] and Search(["a"]).find("") == []
