"""The event source, the pool of calls, table functions and observed counts."""

import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import paging
from foliant.sources import events as E
from foliant.sources import model
from foliant.streaming.rolling import observed


def event_rows(n=200):
    rng = random.Random(1)
    return [(i, json.dumps({"i": i, "t": "é😀x" * rng.randint(0, 60)}, ensure_ascii=False, indent=rng.choice([None, 1]))) for i in range(n)]


@pytest.mark.parametrize("size", [300, 5000, 1 << 20])
def test_events_by_ranges(spark, tmp_path, size):
    spark.dataSource.register(E.EventSource)
    path, rows = str(tmp_path / "log"), event_rows(40 if size < 1000 else 200)
    df = spark.createDataFrame(rows, "i int, event string").repartition(3)
    df.write.format("sse").option("path", path).mode("append").save()
    df.select(F.lit("{bad").alias("event")).limit(2).union(spark.sql("SELECT string(null)")).write.format("sse").option("path", path).mode("append").save()
    got = spark.read.format("sse").option("path", path).option("range", size).load()
    assert sorted(json.loads(r["event"])["i"] for r in got.collect()) == [i for i, _ in rows]
    assert got.groupBy("file", "at").count().where("count > 1").count() == 0
    name = next(n for n in os.listdir(path) if n.startswith("events-"))
    raw = (tmp_path / "log" / name).read_bytes()
    assert raw.endswith(b"\n\n") and raw.startswith(b"data: ")


def test_lines_of_every_cut(tmp_path):
    raw = b"one\n\ntwo two\n" + b"x" * 50 + b"\nlast, not ended"
    (tmp_path / "f").write_bytes(raw)
    want = [(0, b"one"), (4, b""), (5, b"two two"), (13, b"x" * 50)]
    for size in range(1, len(raw) + 2):
        found = []
        for a in range(0, len(raw), size):
            with open(tmp_path / "f", "rb") as f:
                found += E.lines(f, a, min(a + size, len(raw)))
        assert found == want, size


def test_events_of_failed_writes_are_not_read(spark, tmp_path):
    spark.dataSource.register(E.EventSource)
    path = str(tmp_path / "log")
    spark.createDataFrame(event_rows(5), "i int, event string").write.format("sse").option("path", path).mode("append").save()
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.lit("{}")).cast("string").alias("event"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("sse").option("path", path).mode("append").save()
    assert spark.read.format("sse").option("path", path).load().count() == 5
    spark.createDataFrame(event_rows(3), "i int, event string").write.format("sse").option("path", path).mode("overwrite").save()
    assert spark.read.format("sse").option("path", path).load().count() == 3


def test_a_trigger_made_again_counts_once(tmp_path):
    import pyarrow as pa

    w = E.EventStreamWriter(str(tmp_path / "log"), "event")
    batch = pa.RecordBatch.from_pydict({"event": ['{"a": 1}', '{"a": 2}']})
    for _ in range(2):
        w.commit([w.write(iter([batch])), w.write(iter([]))], 4)
    lost = w.write(iter([batch]))
    w.abort([lost, None], 5)
    r = E.EventReader(str(tmp_path / "log"), 1 << 20)
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 2
    assert not [n for n in os.listdir(tmp_path / "log") if n.startswith("_part-")]


def test_pool_keeps_order_and_bound():
    rng, now, most, lock = random.Random(2), 0, 0, threading.Lock()

    def call(m):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(rng.random() / 100)
        with lock:
            now -= 1
        if m == "7":
            raise RuntimeError("down")
        return m * 2

    got = list(model.in_flight(call, ((i, str(i)) for i in range(100)), 6))
    assert [i for i, _, _ in got] == list(range(100)) and 2 <= most <= 6
    assert got[7] == (7, None, "down") and got[8] == (8, "88", None)


def test_pool_begins_nothing_once_its_reader_stops():
    begun = []

    def call(m):
        begun.append(m)
        time.sleep(0.01)
        return m

    answers = model.in_flight(call, ((i, str(i)) for i in range(1000)), 4)
    next(answers)
    answers.close()
    n = len(begun)
    time.sleep(0.1)
    assert len(begun) == n <= 8


def test_cancelled_calls_stop(spark, tmp_path):
    place = str(tmp_path)

    def call(m):
        time.sleep(0.05)
        open(f"{place}/{m}", "w").close()
        return m

    asked = spark.range(20_000).select(F.col("id").alias("request_id"), F.col("id").cast("string").alias("message"))
    calls, failed = model.Calls(spark, "map-7"), []

    def work():
        try:
            calls.run(lambda: model.live(asked, call, 2, 2).count())
        except Exception as e:
            failed.append(e)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(600):
        if os.listdir(place):
            break
        time.sleep(0.05)
    calls.cancel()
    t.join(60)
    n, since = -1, time.time()
    while time.time() - since < 20 and n != len(os.listdir(place)):  # the engine gives a worker two seconds
        n = len(os.listdir(place))
        time.sleep(2)
    assert failed and 0 < n == len(os.listdir(place)) < 3000
    with pytest.raises(RuntimeError, match="cancelled"):
        calls.run(lambda: 1)


def test_table_functions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(1, 30)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, s int").repartition(5)
    want_take, want_pages = {}, {}
    for key in ("a", "b", None):
        mine = [(i, s) for k, i, s in rows if k == key]
        used = taken = page = n = size = 0
        for i, s in mine:
            if s is not None and used + s <= 100:
                used, taken = used + s, taken + 1
            if n and (n == 5 or size + (s or 0) > 60):
                page, n, size = page + 1, 0, 0
            n, size = n + 1, size + (s or 0)
            want_pages[key, i] = (page, n, size)
        want_take[key] = (taken, len(mine) - taken, used)
    assert {r["k"]: tuple(r)[1:] for r in paging.budget_take(df, "k", "i", "s", 100).collect()} == want_take
    assert {(r["k"], r["i"]): tuple(r)[2:] for r in paging.pages(df, "k", "i", F.col("s"), 5, 60).collect()} == want_pages
    assert paging.budget_take(df.limit(0), "k", "i", "s", 100).count() == 0


def test_observed_counts_are_those_of_the_rows_made(spark):
    rows, seen = observed(spark.range(1000).where("id % 3 = 0"), "third", n=F.count("*"), top=F.max("id"))
    made = rows.where("id < 500").collect()
    assert len(made) == 167 and seen.get == {"n": 334, "top": 999}


def test_store_merges_and_prunes(spark, tmp_path):
    from foliant.sources.projects import ProjectStore

    store, want, rng = ProjectStore(spark, str(tmp_path / "s"), group_bytes=1 << 16), {}, random.Random(5)
    store.FAN = 4
    touched = []
    for k in range(24):
        ids = sorted({f"p{rng.randrange(300):03d}" for _ in range(12)})
        if k % 5 == 4:
            store.delete(spark.createDataFrame([(i,) for i in ids], "id string"))
            want = {i: t for i, t in want.items() if i not in ids}
        else:
            rows = [(i, f"{i}/{k}", "n") for i in ids]
            store.put(spark.createDataFrame(rows, "id string, title string, novel string").selectExpr("*", "timestamp'2024-01-01' AS created_at", f"timestamp'2024-01-01' - interval {k} days AS updated_at"))
            want |= {i: t for i, t, _ in rows}
        touched.append(len(store.runs_of("p150", "p150")))
    assert {r["id"]: r["title"] for r in store.scan().collect()} == want
    assert {r["id"] for r in store.scan("p1").collect()} == {i for i in want if i.startswith("p1")} and store.scan("q").count() == 0
    some = next(iter(want))
    assert store.get(some).first()["title"] == want[some] and store.get("p9999").count() == 0
    assert max(touched) <= 3 * 3 and len(store._manifest()["runs"]) <= 9
    plan = store.get(some)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(id,{some})" in plan and "StringStartsWith(id,p1)" in store.scan("p1")._jdf.queryExecution().executedPlan().toString()
