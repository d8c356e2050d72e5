"""What work moves, writes and repeats as tables grow."""

import json
import random
import re
import time
import unicodedata
from collections import Counter

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import batches, headings, identity, relations, repair, rolling_scan, rules, runs, screenplay, segment, structure, trees
from foliant.plans import registry
from foliant.plans import structure as plans
from foliant.sources import model
from foliant.streaming import facts


def test_answers_are_parsed_where_they_lie(spark, monkeypatch):
    """nothing of a text is written or joined but what was found in it."""
    written = []
    put = rules.staged
    monkeypatch.setattr(rules, "staged", lambda df: written.append(df.schema.simpleString()) or put(df))
    raw = spark.createDataFrame([("k1", '{"chunkId":"k1","newFacts":[{"id":"' + "x" * 300_000 + '"}]}')], "chunk_id string, raw string")
    chunks = spark.createDataFrame([("k1", 1, 2, 0)], "chunk_id string, start int, end int, done int")
    got = rules.delta_shapes(raw, chunks, spark.createDataFrame([], "id string, name string"))
    assert {"too_long", "boundary_missing", "range", "list_missing"} == {r["rule"] for r in got.collect()}
    assert written and not any("variant" in x for x in written)


def test_parse_json_is_that_of_the_extracted_text(spark):
    texts = ['{"a":1}', '{"a":1} tail {"b":2}', ' so {"a":"}"} x', '{"a":"```json\\n{}\\n```"}', '```json\n{"a":1}\n```', '{"a":', "none", "[1]", "", None, '{"a":1} ```\n[2]\n```', '{"a" "b"} {"c":1}']
    rows = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = rows.select(F.to_json(model.parse_json(F.col("raw"))).alias("a"), F.to_json(F.try_parse_json(model.extract_json(F.col("raw")))).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] == '{"a":1}'


@pytest.mark.parametrize("name", ["heading_counts", "heading_sample", "heading_context", "heading_gaps", "evidence_serialised", "evidence_once"])
def test_lines_that_look_like_headings_are_not_the_views(spark, tmp_path, name):
    """Addresses, numbers alone, long numbered lines, titles inside texts."""
    texts = ["one\n56.187.231.175 Keit in lich\ntwo", "12.\n3. " + "ab " * 55, "Book Three of it\n# 第一章\nPrologue", "7. " + "x" * 170, "Chapter 1\u0085", "1. short"]
    rows = [(i, t, "fr" if i % 3 else "de") for i, t in enumerate(texts + ["plain text"] * 200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*(c[0] for c in want.description))
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_plans_are_judged_by_the_page(spark):
    """one join of a page's answer with its candidates, never a broadcast of a
    table whose size is guessed."""
    raw = '{"groups":[{"memberIds":["a","a",null,"z","z"],"canonicalName":" ","aliases":[null],"decision":"x"},{"canonicalName":"B","decision":"same"}],"threadGroups":null}'
    answers = spark.createDataFrame([(1, 0, raw), (2, 0, "so " + raw + " it is"), (3, 0, "none")], "novel_id long, page int, raw string")
    rows = [(n, 0, e, i) for n in (1, 2, 3) for e, i in (("char", "a"), ("char", "b"), ("thread", "t"))]
    _, errors = identity.parse_plan(answers, spark.createDataFrame(rows, "novel_id long, page int, entity string, id string"))
    of = [("missing_list", "threadGroups"), ("members_empty", "0"), ("members_empty", "1"), ("name_empty", "0"), ("aliases", "0"), ("aliases", "1"), ("decision", "0"), ("duplicate_member", "a"), ("duplicate_member", "z"), ("unknown_member", None), ("unknown_member", "z"), ("missing_member", "b")]
    got = errors.collect()
    for n in (1, 2):
        assert Counter((r["rule"], r["at"]) for r in got if r["novel_id"] == n) == Counter(of)
    assert [(r["rule"], r["at"]) for r in got if r["novel_id"] == 3] == [("invalid_json", "")]
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_scene_texts_are_read_once(spark):
    """neither scenes nor elements read the texts again."""
    raw = spark.createDataFrame([("p", 0, '{"scenes":[{"id":"z","heading":{"location":"yard"},"elements":[{"type":"action","text":"x"}]}]}')], "project string, ord int, json string")
    for made in screenplay.flatten(raw):
        assert made.count() == 1 and "from_json" not in made._jdf.queryExecution().optimizedPlan().toString().lower()


def test_facts_of_a_trigger_ask_for_an_entry_once():
    """a round trip for each entry that is read or left changed."""
    calls = []

    class Held(dict):
        containsKey = lambda self, k: calls.append(k) or k in self
        getValue = lambda self, k: calls.append(k) or self[k]
        updateValue = lambda self, k, v: calls.append(k) or self.__setitem__(k, v)

    merge = facts.FactMerge()
    merge.active, merge.ids = Held(), Held()
    rows = [(i, "k", f"e{i}", f"v{i}", f"e{i - 1}") for i in range(100)] + [(100, "k", "e7", "v7", None), (101, "k", "e7", "other", None)]
    frames = pd.DataFrame(rows, columns=["ord", "key", "id", "value", "supersedes"])
    got = pd.concat(merge.handleInputRows(("n",), iter([frames.head(50), frames.tail(52)]), None))
    assert list(got["outcome"]) == ["new"] + ["replace"] * 99 + ["merge", "conflict"]
    assert merge.active == {("k",): ("e99", "v99")} and len(merge.ids) == 100
    assert len(calls) == 2 * 100 + 2


def test_rows_of_conflicts_are_made_once(spark):
    """no rule makes the derived rows again."""
    got = registry.QUERIES["conflict_reports"](spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in got.inputFiles())


def test_trees_are_rewritten_where_they_lie(spark):
    """nothing is written between, the lines move once, and equal ids stay apart."""
    deep = '{"in":' * 300 + '{"paragraphRange":{"start":2,"end":3.0},"chunkId":"a","z\\u001f":"\\u4e00\\"/"}' + "}" * 300
    docs = spark.createDataFrame([(1, deep), (1, '[{"chunkId":"a","paragraphRange":{"start":2.5,"end":3}},[]]'), (None, '{"b":1e2,"a":{}}'), (2, '{"a":1,"a":2}'), (3, "7")], "id int, json string")
    ranges = spark.createDataFrame([(1, "a", 'k"\x1f', 1, 9), (1, "a", "late", 2, 9), (1, None, "x", 1, 9)], "id int, chunk_id string, chapter_id string, start int, end int")
    made, bad = trees.with_chapters(docs, ranges)
    got = {(r["id"], r["json"]) for r in made.collect()}
    tree = '{"in":' * 300 + '{"chapterId":"k\\"\\u001F","chunkId":"a","paragraphRange":{"end":3,"start":2},"z\\u001F":"一\\"/"}' + "}" * 300
    assert got == {(1, tree), (1, '[{"chunkId":"a","paragraphRange":{"end":3,"start":2.5}},[]]'), (None, '{"a":{},"b":100.0}'), (3, "7")}
    assert {(r["id"], r["path"], r["rule"]) for r in bad.collect()} == {(1, "/0", "range_invalid")}


def test_state_changes_of_many_novels_share_a_batch(spark):
    """novels aren't groups of their own; one that lies in several batches is one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    facts = spark.createDataFrame([(f"n{i}", "f0", "loc", "v", None) for i in range(300)], "novel_id string, id string, key string, value string, superseded_by string")
    pair = [(f"n{i}", f"f{k}", f"f{k + 1}", k) for i in range(300) for k in range(5)]
    conflicts = spark.createDataFrame([(n, f"x{b}", a, b, "own" if k == 3 else "loc", b) for n, a, b, k in pair], "novel_id string, conflict_id string, existing_id string, incoming_id string, key string, value string")
    changes = spark.createDataFrame([(n, k, a, b) for n, a, b, k in pair], "novel_id string, ord long, existing_id string, incoming_id string")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        after, status = repair.apply_state_changes(facts, conflicts, changes)
        assert "FlatMapGroups" not in after._jdf.queryExecution().executedPlan().toString()
        got = Counter((r["id"], r["supersedes"], r["superseded_by"]) for r in after.collect())
        assert got == {("f0", None, "f1"): 300, ("f1", "f0", "f2"): 300, ("f2", "f1", "f3"): 300, ("f3", "f2", None): 300}
        assert Counter((r["conflict_id"], r["status"]) for r in status.collect()) == {(f"xf{k}", "resolved" if k < 4 else "open"): 300 for k in range(1, 6)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_transitions_are_found_by_their_values(spark):
    """F16: pairs of an entity's facts that don't account for a change are never made."""
    n = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") + 1).cast("string").alias("next"))
    issues = n.select(F.concat(F.lit("i"), "k").alias("issue_id"), F.lit("object").alias("entity_type"), F.lit("o").alias("entity_id"), F.lit("state").alias("field"), F.col("k").alias("exit"), F.col("next").alias("entry"))
    facts = n.select(F.concat(F.lit("f"), "k").alias("id"), F.lit("object").alias("kind"), F.lit("O").alias("subject_id"), F.lit("state").alias("predicate"), F.col("k").alias("value"), F.lit("s").alias("statement"), F.lit(None).cast("string").alias("perspective_id"))
    got = {tuple(r) for r in repair.allowed_transitions(issues, facts).collect()}
    assert got == {(f"i{k}", f"f{k}", f"f{k + 1}") for k in range(2999)}


def test_pairs_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    """tasks grow with the rows and the pairs, whatever the session has."""
    asked = []
    monkeypatch.setattr(relations, "pieces", lambda _, rows, most=0: asked.append(rows) or 37)
    members = spark.createDataFrame([(g, v) for g in range(40) for v in (1, 2, 3)] * 2 + [(None, 1), (None, 2), (7, None), (99, 1)], "g long, v long")
    edges = relations.cooccurrence(members, "g", "v")
    assert edges.rdd.getNumPartitions() == 37 and asked == [244, 120]
    assert {tuple(r) for r in edges.collect()} == {(1, 2, 40), (1, 3, 40), (2, 3, 40)}
    for once in (False, True):
        assert {tuple(r) for r in relations.degrees(edges, once).collect()} == {(1, 2), (2, 2), (3, 2)}
    assert batches.pieces(spark, 100 << 19) == 100


def test_a_pool_asks_large_requests_in_waves(spark, monkeypatch):
    """a task reads no more than its share, every request is asked once and no
    stage has more tasks than the pool."""
    monkeypatch.setattr(model, "TASK_BYTES", 2_000)
    rows = [(i, None if i % 50 == 0 else f"m{i}" + "x" * 80) for i in range(200)]
    made = []
    put = model.staged
    monkeypatch.setattr(model, "staged", lambda df, *by: made.append(df if by else df.rdd.getNumPartitions()) or put(df, *by))
    got = model.live(spark.createDataFrame(rows, "request_id long, message string"), lambda m: (m or "none").upper(), 2, 3)
    assert len(made) > 4 and set(made[1:]) == {2}
    assert Counter(map(tuple, got.collect())) == Counter((i, (m or "none").upper(), None) for i, m in rows)


def test_split_texts_come_in_small_batches(spark):
    """a worker holds no batch of 10,000 whole texts."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], str(256 << 20))
        segment.split_oversized(spark.createDataFrame([("a", ["b"])], "novel_id string, paras array<string>"))
        assert spark.conf.get(keys[0]) == "1000" and spark.conf.get(keys[1]) == str(32 << 20)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chapters_are_made_where_the_texts_lie(spark, monkeypatch):
    """no text is ordered, joined or written but that of candidates, and what
    is written once more is of candidates, chapters and chunks."""
    moved, written = [], []
    put = runs.staged
    monkeypatch.setattr(runs, "staged", lambda df: moved.append(df.count()) or put(df))
    monkeypatch.setattr(structure, "staged", lambda df: written.append((df.schema.simpleString(), df.count())) or put(df))
    novels = spark.createDataFrame([(k, "\n".join(["Chapter 1", *["plain text"] * 200, "Chapter 2", *["more of it"] * 200])) for k in range(3)], "novel_id long, text string")
    none = lambda pages: pages.select("novel_id", "page").distinct().withColumn("raw", F.lit('{"headings":[{"headingParagraph":202,"role":"chapter","decision":"selected"}]}'))
    made = structure.chapter_first(novels, none)
    assert sorted((r["novel_id"], r["start"], r["end"], r["title"]) for r in made["chapters"].collect()) == [x for k in range(3) for x in ((k, 1, 201, "开篇"), (k, 202, 402, "Chapter 2"))]
    assert max(moved, default=0) <= 6 and max(n for _, n in written) <= 6
    assert sum("paras:array" in s for s, _ in written) == 1
    assert "paras" not in made["chunks"]._jdf.queryExecution().executedPlan().toString()


def test_only_texts_that_may_be_headings_are_normalised(spark):
    """a text's first characters say whether it can be a heading; what is found
    is what is found without asking them."""
    pick = random.Random(3)
    parts = ["chapter", "Part", "cha", "pt", "er", "p", "se", "ction", "1", "12", ".", "．", "、", " ", "　", "\u00a0", "\u0301", "é", "ß", "ſ", "ﬁ", "ı", "Ｃ", "ｐ", "ａrt", "第", "三", "章", "卷", "楔子", "#", "**", "【", "】", "[", "_", "¨", "ª", "x", "Book", "pro", "logue", "\u200b", "Å"]
    texts = ["".join(pick.choices(parts, k=pick.randint(1, 7))) for _ in range(2000)] + [a + b + c for a in parts for b in parts for c in (" 1", "三章", "．x")] + [f"{w} one" for w in headings.WORDS] + ["ſection 1", "Chapter\u0301 1", "afterword\u0301 x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {(r["n"], r["level"], r["normalized"], *r["signals"]) for r in headings.classify(rows).collect()}
    flat = spark.createDataFrame([(n, unicodedata.normalize("NFKC", re.sub(f"^[{text.SPACES}]+|[{text.SPACES}]+$", "", t))) for n, t in enumerate(texts)], "n int, t string")
    every = flat.select("n", headings._classified(headings.unwrap(F.col("t"))).alias("h")).where("h.fits").select("n", "h.*").collect()
    assert got == {(r["n"], r["level"], r["normalized"], *r["signals"]) for r in every} and len(got) > 100
    plain = ["Für dich und mich", "die Straße war schön", "chap für", "sé quién"]
    assert [r["x"] for r in spark.createDataFrame([(t,) for t in plain], "t string").select(headings.may_open(F.col("t")).alias("x")).collect()] == [False] * 4


def test_lines_are_trimmed_of_white_space_alone(spark):
    """the class of the pattern, from the ends; a line end that is none of it
    is text, whatever stands before it."""
    texts = ["".join(p) for p in (" a \u0085", "\u3000\ufeffa b\u2009", "\r\n\r a\n\n b\r", "", "\x0b", "é\u00a0", "a\rb\r\nc\nd", "\u200b x")]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.trim(F.col("t")).alias("trim"), text.lines(F.col("t")).alias("lines"))
    trim = lambda x: x.strip(text.SPACES)
    for r in rows.collect():
        t = texts[r["k"]]
        assert r["trim"] == trim(t) and r["lines"] == [x for x in map(trim, re.split(r"\r\n|\n|\r", t)) if x]
    every = spark.range(0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    assert {r["c"] for r in every.where(F.col("c").rlike(text.WS)).collect()} == set(text.SPACES)


def test_context_and_costs_of_arrays_are_those_of_rows(spark):
    """the same candidates and chapters, by arrays and by rows."""
    novels = spark.createDataFrame([("a", ["Chapter 1", "x  y" * 200, "第二章", "é" * 90, "Chapter 3"]), ("b", ["plain"]), ("c", []), ("d", ["Part 1", "Part 2"])], "novel_id string, paras array<string>")
    flat = novels.select("novel_id", F.posexplode("paras").alias("i", "text")).select("novel_id", (F.col("i") + 1).alias("n"), "text")
    of = lambda df: sorted(map(tuple, headings.classify(df).select("novel_id", "n", "text", "before", "after", "upto", "level").collect()))
    assert of(headings.context_of(novels)) == of(headings.with_context(flat)) and len(of(headings.context_of(novels))) == 5
    s, p = plans.resolved(spark)
    lengths = p.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("n", F.length("text").alias("x")))).alias("l")).select("novel_id", F.col("l.x").alias("lengths"))
    rows, arrays = structure.chapter_rows(s, p), structure.chapter_rows(s, None, lengths)
    assert rows.columns == arrays.columns and Counter(map(tuple, rows.collect())) == Counter(map(tuple, arrays.collect()))


@pytest.mark.parametrize("target,overlap", [(60, 0), (400, 300), (60, 20), (14, 0), (60, 2)])
def test_only_long_paragraphs_cross_to_be_cut(spark, target, overlap):
    """novels that hold none stay as they are; at every length the cuts are the same."""
    paras = [["x" * n, "y。" * (n // 2)] for n in (*range(1, 70), *range(250, 310), *range(380, 405))] + [None, []]
    made = segment.split_oversized(spark.createDataFrame(list(enumerate(paras)), "novel_id int, paras array<string>"), target, overlap)
    room = lambda t: len(str(max(1, len(t), sum(map(len, t))))) + 2
    for r in made.collect():
        t = paras[r["novel_id"]] or []
        core, over = target - room(t), overlap - room(t)
        long = lambda x: len(x) > core or (over > 0 and len(x) > over and len(x) >= 256)
        assert r["paras"] == [p for x in t for p in (segment.split_by_budget(x, min(core, over) if over > 0 else core) if long(x) else [x])]
    assert "CASE WHEN exists" in made._jdf.queryExecution().optimizedPlan().toString()


def test_projects_meet_without_broadcasts(spark):
    """keys of projects don't go through the driver, however few bytes they take,
    and only projects with new scenes are checked again."""
    good = '{"scenes":[{"id":"z","heading":{"setting":"INT","location":"yard","time":"DAY"},"elements":[{"type":"transition","text":"cut"}]}]}'
    bad = good.replace("yard", "").replace('"cut"', '" "')
    p = spark.range(600).select(F.col("id").alias("project"), F.lit("T").alias("title"))
    c = p.select("project", F.lit(0).alias("ord"), F.lit("x").alias("id"), F.lit("X").alias("name"), F.array().cast("array<string>").alias("aliases"))
    text = F.when(F.col("project") % 3 == 0, bad).otherwise(good)
    b = p.select("project", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).withColumn("json", text)
    asked = []

    def repair(errors):
        asked.append(errors)
        return p.where("project % 2 = 0").select("project", F.lit(good).alias("json"))

    got = screenplay.generate(p, c, b, repair)
    plan = got["status"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    none = p.select("project", F.lit(0).alias("pos"), F.lit("").alias("scene_id")).where("false")
    plan = screenplay.violations(p, c, got["scenes"], got["elements"], none)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert Counter((r["project"], r["rule"], r["path"]) for r in asked[0].collect()) == {(k, rule, path): 1 for k in range(0, 600, 3) for s in (0, 1) for rule, path in (("location", f"scenes[{s + 1}].heading.location"), ("text", f"scenes[{s + 1}].elements[0].text"))}
    assert {tuple(r) for r in got["status"].collect()} == {(k, 4 if k % 6 == 3 else 0, 1 if k % 6 == 0 else 2, k % 3 == 0, 1 if k % 6 == 0 else 2) for k in range(600)}
    assert Counter((r["project"], r["scene"]) for r in got["scenes"].collect()) == {(k, s): 1 for k in range(600) for s in ((1,) if k % 6 == 0 else (1, 2))}
    assert got["elements"].count() == got["scenes"].count()
    assert Counter(r["rule"] for r in got["violations"].collect()) == {"location": 200, "text": 200, "source": 1100}


def test_novels_of_few_facts_are_one_entry(monkeypatch):
    """a trigger reads and writes a novel's state once; beyond FEW facts its
    entries lie in the maps, and the outcomes stay those of one fold."""

    class Held(dict):
        containsKey = lambda self, k: k in self
        getValue = lambda self, k: self[k]
        updateValue = lambda self, k, v: self.__setitem__(k, v)

    class One:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    rng = random.Random(2)
    rows = [(i, rng.choice(["k", None, 'q"\\']), f"e{rng.randrange(60)}" if rng.random() < 0.9 else None, rng.choice(["a", "b", "\0"]), f"e{rng.randrange(60)}" if rng.random() < 0.8 else None) for i in range(200)]
    want, *_ = facts.fold("n", rows, facts.Entries(), facts.Entries())
    assert {x[4] for x in want} == {"new", "merge", "replace", "conflict"}
    for few in (512, 5, 0):
        monkeypatch.setattr(facts, "FEW", few)
        merge, got = facts.NovelMerge(), []
        merge.active, merge.ids, merge.few = Held(), Held(), One()
        for k in range(0, 200, 20):
            texts = [json.dumps({c: v for c, v in zip(facts.FACT, r, strict=True) if v is not None}) for r in rows[k : k + 20]]
            rng.shuffle(texts)
            packed = pd.concat(facts.packs(iter([pd.DataFrame({"novel_id": "n", "fact": texts[a : a + 8]}) for a in (0, 8, 16)])))
            assert len(packed) == 3
            made = list(merge.handleInputRows(("n",), (Row(novel_id="n", facts=t) for t in packed["facts"]), None))
            got += [("n", *x) for r in made for x in json.loads(r["found"])]
        assert got == want
        assert merge.few.calls <= 2 * 10 and bool(merge.ids) == (few < 512) and (merge.few.held == (None,)) == (few < 512)


def test_conflicts_meet_their_rows_step_by_step(spark):
    """what is left to a reader is one join, and no step leaves shuffle files;
    rows that come twice, nulls and unknown ids give what a join a rule gives."""
    rng = random.Random(3)
    some = lambda *x: rng.choice([*x, None])
    closed = [(some("c", "d"), some(*"xyzw"), some("guess", *rules.RESOLUTIONS), some(" ", "why"), some("", *"fghi")) for _ in range(150)]
    opened = [(some(*"xyzv"), some("open", "resolved"), some(*"fgh"), some("Old", "new")) for _ in range(9)]
    known = [(some(*"fgh"), some("k", "j"), some("o ld", "NEW"), some(*"fg")) for _ in range(7)]
    frames = [spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split())) for rows, columns in ((closed, "chunk_id id resolution explanation fact_id"), (opened, "id status existing_id incoming_value"), (known, "id key value supersedes"))]
    norm = lambda t: (t or "").lower().replace(" ", "")
    join = lambda k, rows, of: [r for r in rows if k is not None and r[0] == k] or [(None,) * of]
    want = Counter()
    for row, n in Counter((c[0], c[1]) for c in closed).items():
        want[("conflict_twice", *row)] += n > 1
    for chunk, i, kind, why, f in closed:
        say = lambda rule, when=True: want.update({(rule, chunk, i): int(when)})  # noqa: B023, E731
        for o in join(i, opened, 4):
            say("conflict_not_open", o[1] != "open")
        say("conflict_explanation", not (why or "").strip())
        say("conflict_resolution", kind not in rules.RESOLUTIONS)
        say("conflict_fact_missing", not f)
        say("conflict_fact", f is not None and f not in [k[0] for k in known])
        for o in join(i, [o for o in opened if o[1] == "open"], 4):
            for old in join(o[2], known, 4):
                for new in join(f, known, 4):
                    after = new[3] is not None and new[3] == o[2]
                    same = norm(new[2]) == norm(old[2]) if kind == "confirmed_existing" else norm(new[2]) == norm(o[3]) and after if kind == "confirmed_incoming" else after if kind in ("state_change", "correction") else True
                    sided = o[3] is not None and old[1] is not None
                    say("conflict_unstructured", not sided)
                    say("conflict_fact_unrelated", sided and new[1] is not None and not (norm(new[1]) == norm(old[1]) and same))
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    had = files()
    report = rules.conflict_report(*frames)
    until = time.time() + 20
    while files() > had and time.time() < until:
        time.sleep(0.2)
    assert files() <= had
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan
    of = Counter()
    for (rule, chunk, i), n in want.items():
        of[(rule, "/".join(["conflicts", *([chunk] if chunk else []), i or ""]))] += n
    assert Counter((r["rule"], r["path"]) for r in report.collect()) == +of and len({r for r, _ in +of}) == 8
    first = {"conflict_not_open", "conflict_explanation", "conflict_fact", "conflict_twice"}
    assert {r["rule"] for r in rules.conflict_rules(*frames).collect()} == first
    assert {r["rule"] for r in rules.closing_rules(*frames).collect()} == {r for r, _ in +of} - first


def test_novels_inside_a_partition_are_folded_once(spark, monkeypatch):
    """only novels at the ends of partitions and those of many facts are scanned."""
    rng = random.Random(4)
    size = {f"n{k:02}": 40 if k == 30 else 8 for k in range(60)}
    made = [(n, i // 2, rng.choice(["K", "k", "j", None]), f"e{rng.randrange(9)}" if rng.random() < 0.9 else None, rng.choice(["a", "b", None]), f"e{rng.randrange(9)}") for n, m in size.items() for i in range(m)]
    df = spark.createDataFrame(made, "novel_id string, ord long, key string, id string, value string, supersedes string").repartition(3)
    scanned, scan = [], rolling_scan._composed
    monkeypatch.setattr(rolling_scan, "_composed", lambda rows, *more: scanned.append(rows) or scan(rows, *more))
    got = Counter(map(tuple, rolling_scan.roll_facts(df, block=16).collect()))
    novels = {r[0] for r in scanned[0].select("novel_id").distinct().collect()}
    assert "n30" in novels and len(novels) <= 2 * 4 + 1
    all_ = rolling_scan._composed(rolling_scan.normal(df).select(*rolling_scan.FACT[:4], F.coalesce("value", F.lit("\0")).alias("value"), "supersedes"), 16, 2)
    assert got == Counter(map(tuple, all_.collect())) and {x[4] for x in got} == {"new", "merge", "replace", "conflict"}
    parts = [pa.RecordBatch.from_pylist([dict(zip(rolling_scan.FACT, ("x", i, "k", f"e{i}", "v", None), strict=True)) for i in range(a, a + 50)], schema=pa.schema([(c, pa.int64() if c == "ord" else pa.string()) for c in rolling_scan.FACT])) for a in (0, 50)]
    assert [len(b) for b in rolling_scan.inside(4096)(iter(parts))] == [50, 50]  # a novel that may begin before isn't held
