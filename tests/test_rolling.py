"""Chains, the composed scan, keyed streaming state and resumed runs, trees and
JSON in dirty text, against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import chains, rolling_scan, trees
from foliant.operators.knowledge import roll_facts as folded
from foliant.sources import model
from foliant.streaming.facts import Run, RunFailed, merge_facts


def follow(links, start):
    """The plain chase: (head, steps, cyclic)."""
    at, seen = start, []
    while at in links and at not in seen:
        seen.append(at)
        at = links[at]
    return (at, seen.index(at), True) if at in seen else (at, len(seen), False)


@pytest.mark.parametrize("seed", range(3))
def test_chase(spark, seed):
    rng = random.Random(seed)
    links = {i: rng.choice([i - 1, i - 1, i - 1, rng.randrange(400), i]) for i in range(1, 300)}
    rows = [*links.items(), (None, 3), (500, None), (7, links[7] + 1000)]
    links[7] = min(links[7], links[7] + 1000)
    got = {r["id"]: (r["head"], r["steps"], r["cyclic"]) for r in chains.chase(spark.createDataFrame(rows, "id long, to long")).collect()}
    assert got == {i: follow(links, i) for i in links}


def test_chase_takes_log_rounds(spark, monkeypatch):
    made = []
    keep = chains.staged
    monkeypatch.setattr(chains, "staged", lambda df: made.append(1) or keep(df))
    got = chains.chase(spark.range(1, 10_000).select("id", (F.col("id") - 1).alias("to")))
    assert got.where("head <> 0 or steps <> id or cyclic").count() == 0 and got.count() == 9_999
    assert len(made) <= 17


def test_chase_of_nothing(spark):
    assert chains.chase(spark.createDataFrame([], "id long, to long")).count() == 0
    assert [tuple(r) for r in chains.chase(spark.createDataFrame([(1, 1)], "id long, to long")).collect()] == [(1, 1, 0, True)]


SCHEMA = "novel_id string, ord long, key string, id string, value string, supersedes string"


def random_facts(seed, n=600):
    """Facts of which many share ids across keys and supersede what is active."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        novel = rng.choice(["n", "n", "n", "m"])
        key = rng.choice(["A ", "a", "b", "c"]) if rng.random() < 0.6 else "hot"
        ident = f"f{rng.randrange(n)}" if rng.random() < 0.3 else f"g{i}"
        past = [r for r in out[-8:] if r[0] == novel]
        sup = rng.choice(past)[3] if past and rng.random() < 0.7 else None
        out.append((novel, i, key, ident, rng.choice(["x", "y", "z"]), sup))
    return out


@pytest.mark.parametrize("seed,block,fan", [(0, 7, 2), (1, 5, 3), (2, 40, 64), (3, 4096, 64)])
def test_composed_scan_equals_the_fold(spark, seed, block, fan):
    df = spark.createDataFrame(random_facts(seed), SCHEMA)
    want = sorted(map(tuple, folded(df).collect()), key=str)
    got = rolling_scan.roll_facts(df, block=block, fan=fan)
    assert got.columns == ["novel_id", "ord", "key", "id", "outcome", "active"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[4] for r in want} == {"new", "merge", "replace", "conflict"}


def test_effects_compose():
    rng = random.Random(4)
    for _ in range(300):
        facts = [(f"i{k}", rng.choice("xy"), rng.choice([None, "p", "q", f"i{k - 1}"])) for k in range(rng.randint(0, 8))]
        cut = rng.randint(0, len(facts))
        left, right = rolling_scan.Effect.of(facts[:cut]), rolling_scan.Effect.of(facts[cut:])
        whole = left.then(right)
        again = rolling_scan.unpacked(*rolling_scan.packed(whole))
        for state in ((), ("p", "x"), ("p", "y"), ("q", "x"), ("r", "y")):
            want = state
            for f in facts:
                want = rolling_scan.after(want, f)[0]
            assert whole(state) == again(state) == right(left(state)) == want


def test_composed_scan_of_nothing_and_of_repeats(spark):
    assert rolling_scan.roll_facts(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("n", 1, "k", "a", "x", None), ("n", 2, "k", "a", "x", None), ("n", 3, "j", "a", "x", None), ("n", 4, "k", "b", None, "a")], SCHEMA)
    assert [r["outcome"] for r in rolling_scan.roll_facts(df, block=1, fan=2).orderBy("ord").collect()] == ["new", "merge", "conflict", "replace"]


def land(df, folder, cuts):
    for cut in cuts:
        df.where(cut).coalesce(1).write.mode("append").parquet(folder)
        yield cut


def bounds(batch):
    r = batch.agg(F.min("ord"), F.max("ord")).first()
    return {"start": r[0], "end": r[1]}


def test_stream_resumes_after_failures(spark, tmp_path):
    df = spark.createDataFrame([r for r in random_facts(5, 90)], SCHEMA)
    want = sorted(map(tuple, folded(df).collect()), key=str)
    source, path = str(tmp_path / "in"), str(tmp_path / "run")
    faults = [("written", 1), ("committed", 2)]
    stream = lambda: merge_facts(spark.readStream.schema(SCHEMA).parquet(source))

    def hook(what, number):
        if (what, number) in faults:
            faults.remove((what, number))
            raise OSError("lost")

    failed = []
    for _ in land(df, source, ["ord < 30", "ord >= 30 and ord < 60", "ord >= 60"]):
        while True:
            run = Run(spark, path, "v1")
            try:
                run.go(stream(), bounds, hook)
                break
            except RunFailed as e:
                failed.append((e.durable, e.boundary["end"], run.results().count()))
    assert failed == [(0, 29, 30), (2, 89, 90)]
    assert sorted(map(tuple, run.results().collect()), key=str) == want
    assert Run(spark, path, "v1").durable() == (2, {"start": 60, "end": 89})
    with pytest.raises(ValueError, match="another source"):
        Run(spark, path, "v2")
    with pytest.raises(ValueError):
        Run(spark, path, " ")


def test_stream_refuses_a_gap(spark, tmp_path):
    df = spark.createDataFrame(random_facts(6, 40), SCHEMA)
    source, path = str(tmp_path / "in"), str(tmp_path / "run")
    for k, _ in enumerate(land(df, source, ["ord < 10", "ord >= 20"])):
        run = Run(spark, path, "v1")
        stream = merge_facts(spark.readStream.schema(SCHEMA).parquet(source))
        if k:
            with pytest.raises(RunFailed) as e:
                run.go(stream, bounds)
            assert e.value.durable == 0 and run.results().count() == 10
        else:
            assert run.go(stream, bounds) == (0, {"start": 0, "end": 9})


def test_state_written_grows_with_the_rows_of_a_trigger(spark, tmp_path):
    big = spark.range(3000).select(F.lit("n").alias("novel_id"), F.col("id").alias("ord"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"), F.lit("x").alias("value"), F.lit(None).cast("string").alias("supersedes"))
    source, path = str(tmp_path / "in"), str(tmp_path / "run")
    sizes = []
    for _ in land(big, source, ["ord < 2990", "ord >= 2990"]):
        q = merge_facts(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("noop").option("checkpointLocation", path).trigger(availableNow=True).start()
        q.awaitTermination()
        done = [p for p in q.recentProgress if p["numInputRows"]]
        sizes.append((done[0]["stateOperators"][0]["numRowsUpdated"], done[0]["stateOperators"][0]["numRowsTotal"]))
    assert sizes[0][0] >= 2990 * 2 and sizes[1][0] <= 40 and sizes[1][1] >= 6000


def plain_json(text):
    a = text.find("{")
    if a < 0:
        return text
    depth, quoted, skip = 0, False, False
    for i in range(a, len(text)):
        c = text[i]
        if quoted:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[a : i + 1]
    return text[a:]


def test_balanced_objects(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice('{}"\\ab\né😀[],:') for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ['{"a": "' + '\\"' * 20_000 + '"} tail', "{" * 5000 + "}" * 5000 + "x", "a" * 100_000, 'x {"k": "}"} y', "}{", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = df.select("i", model.balanced(F.col("t")).alias("b"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r["i"]: r["b"] for r in got.collect()}
    assert found == {i: plain_json(t) for i, t in enumerate(texts)} | {-1: None}


def inject(value, chapters):
    if isinstance(value, list):
        return [inject(v, chapters) for v in value]
    if not isinstance(value, dict):
        return value
    out = {k: inject(v, chapters) for k, v in value.items()}
    r = out.get("paragraphRange")
    if isinstance(out.get("chunkId"), str) and isinstance(r, dict):
        fit = [c for chunk, c, s, e in chapters if chunk == out["chunkId"] and isinstance(r.get("start"), int) and isinstance(r.get("end"), int) and s <= r["start"] and r["end"] <= e]
        if fit:
            out["chapterId"] = fit[0]
    return out


def random_value(rng, depth):
    kind = rng.random()
    if not depth or kind < 0.2:
        return rng.choice([1, -5, "x", 'q"\\\n', None, True, {}, [], "漢"])
    if kind < 0.5:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 12))]
    if kind < 0.75:
        s = rng.randint(1, 20)
        return {"chunkId": rng.choice(["c1", "c2", 'c"3', 4]), "paragraphRange": rng.choice([{"start": s, "end": s + rng.randint(0, 3)}, {"start": s}, None]), "chapterId": "old", "z": random_value(rng, depth - 1)}
    return {rng.choice(["a", "b/c", "é", "", 'k"y', "same"]) + str(k): random_value(rng, depth - 1) for k in range(rng.randint(0, 4))}


def test_trees(spark):
    rng = random.Random(3)
    docs = [(i, random_value(rng, 7)) for i in range(60)]
    chapters = [("c1", "k1", 1, 6), ("c1", "k2", 7, 12), ("c2", "k3", 1, 20), ('c"3', 'k"4', 5, 9)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in docs] + [(100, "{broken"), (101, None)], "id int, json string")
    ranges = spark.createDataFrame([(i, *c) for i, _ in docs for c in chapters], "id int, chunk_id string, chapter_id string, start int, end int")
    done, bad = trees.with_chapters(df, ranges)
    got = {r["id"]: json.loads(r["json"]) for r in done.collect()}
    assert got == {i: inject(v, chapters) for i, v in docs}
    assert {r["rule"] for r in bad.collect()} == {"range_invalid", "range_crosses"}
    assert "chunk_unknown" in {r["rule"] for r in trees.with_chapters(df, ranges.where("chunk_id <> 'c1'"))[1].collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_runs_equal_windows(spark, partitions):
    from pyspark.sql import Window as W

    from foliant.operators.runs import Runs

    rng = random.Random(partitions)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randint(0, 9), f"t{i}") for i in range(400)]
    rows += [(f"k{i}", 1, 1, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, n int, v int, t string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = Runs(df, ["k"], ["n"]).total("upto", F.col("v")).count("all").neighbours("t", "b", "a").table()
        assert got.columns == ["k", "n", "v", "t", "upto", "all", "b", "a"]
        found = sorted(map(tuple, got.collect()), key=str)
        whole = sorted(map(tuple, Runs(df, [], ["k", "n"]).total("upto", F.lit(1)).table().select("k", "n", "upto").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    w = W.partitionBy("k").orderBy("n")
    want = df.select("*", F.sum("v").over(w).alias("upto"), F.count("*").over(W.partitionBy("k")).alias("all"), F.lag("t").over(w).alias("b"), F.lead("t").over(w).alias("a"))
    assert found == sorted(map(tuple, want.collect()), key=str)
    assert whole == sorted(map(tuple, df.select("k", "n", F.row_number().over(W.orderBy("k", "n")).alias("upto")).collect()), key=str)
