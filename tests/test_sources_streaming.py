import io
import time
import zipfile

from pyspark.sql import functions as F

from foliant.operators.knowledge import roll_facts
from foliant.sources import files, model
from foliant.sources.projects import ProjectStore
from foliant.streaming import rolling


def test_text_and_docx(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("一\n二\n")
    assert [r["text"] for r in files.read_text(spark, str(tmp_path / "t")).collect()] == ["一\n二\n"]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>第一章</w:t><w:tab/><w:t>雨</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.docx").write_bytes(raw.getvalue())
    (tmp_path / "d/b.docx").write_bytes(b"no zip")
    got = {r["path"][-6:]: r["text"] for r in files.read_docx(spark, str(tmp_path / "d")).collect()}
    assert got == {"a.docx": "第一章\t雨\n\nb\n\n", "b.docx": None}
    files.write_texts(spark.createDataFrame([("n1", "x\ny")], "name string, text string"), "name", "text", str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/name=n1")).collect()] == ["x", "y"]


def test_yaml_round_trip(spark):
    df = spark.createDataFrame([("a", '{"b": 1, "a": ["苏禾", null]}')], "id string, j string")
    back = files.from_yaml(files.to_yaml(df, "id", "j"), "id", "yaml").first()["json"]
    assert back == '{"b": 1, "a": ["苏禾", null]}'
    assert files.from_yaml(spark.createDataFrame([("a", "a: [")], "id string, y string"), "id", "y").first()["json"] is None


def test_project_store(spark, tmp_path):
    s = ProjectStore(spark, str(tmp_path / "p"))
    row = lambda i, t, at: spark.sql(f"SELECT '{i}' id, '{t}' title, 'n' novel, timestamp'2024-01-01' created_at, timestamp'{at}' updated_at")
    s.put(row("p1", "a", "2024-01-01"))
    s.put(row("p2", "b", "2024-01-02"))
    s.put(row("p1", "c", "2024-01-03"))
    assert [(r["id"], r["title"]) for r in s.scan("p").collect()] == [("p1", "c"), ("p2", "b")]
    s.delete(spark.sql("SELECT 'p1' id"))
    assert [r["id"] for r in s.scan().collect()] == ["p2"] and s.get("p1").count() == 0 and s.get("p2").first()["title"] == "b"


DELTAS = [("n", 1, "loc", "f1", "street", None), ("n", 2, "loc", "f2", "yard", "f1"), ("n", 3, "loc", "f3", "house", None), ("m", 1, "loc", "f1", "x", None), ("n", 4, "loc", "f4", "yard", None), ("n", 5, "loc", "f1", "house", None)]
SCHEMA = "novel_id string, ord long, key string, id string, value string, supersedes string"


def test_rolling_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()
    full = spark.createDataFrame(DELTAS, SCHEMA)
    want = sorted(tuple(r) for r in roll_facts(full).collect())
    for k, cut in enumerate(("ord <= 2", "ord > 2")):
        full.where(cut).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(SCHEMA).parquet(str(src))
        q = rolling.rolling_facts(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "res")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()  # the second run resumes from the checkpoint
        out.append(spark.read.parquet(str(tmp_path / "res")).count())
    assert out[0] == 3 and sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "res")).collect()) == want


def test_pending_and_commit(spark, tmp_path):
    chunks = spark.createDataFrame([("n", "c1", "x"), ("n", "c2", "x")], "novel_id string, chunk_id string, fingerprint string")
    done = chunks.where("chunk_id = 'c1'")
    assert [r["chunk_id"] for r in rolling.pending(chunks, done).collect()] == ["c2"]
    assert rolling.pending(chunks, done.withColumn("fingerprint", F.lit("y"))).count() == 2
    chunks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))
    q = rolling.commit_each(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.withColumn("n", F.length("chunk_id")))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_progress(spark):
    assert rolling.progress("map", 1, 3)["percent"] == 40
    df = spark.createDataFrame([(0, "map", 1, 3)], "pos int, stage string, completed int, total int")
    event = rolling.progress_events(df)
    assert model.sse_events(event.select("pos", "event").withColumnRenamed("pos", "k"), "event").count() == 1


def test_model_client(spark):
    req = spark.createDataFrame([(1, "a"), (2, "boom")], "request_id long, message string")

    def call(m):
        if m == "boom":
            raise RuntimeError("down")
        return m.upper()

    assert {r["request_id"]: (r["raw"], r["error"]) for r in model.live(req, call, 2).collect()} == {1: ("A", None), 2: (None, "down")}
    assert {r["request_id"]: r["raw"] for r in model.recorded(req, spark.createDataFrame([(1, "x")], "request_id long, raw string")).collect()} == {1: "x", 2: None}
    got = spark.createDataFrame([('say {"a": 2} ok',), ("none",)], "t string").select(model.safe_parse(F.col("t"), "a int", F.struct(F.lit(0).alias("a"))).alias("v")).collect()
    assert [r["v"]["a"] for r in got] == [2, 0]


def test_listener_reports_every_trigger(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen, ended = [], []
    listener = rolling.Listener(seen.append, ended.append)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        q = stream.writeStream.queryName("map").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert seen and seen[-1]["stage"] == "map" and seen[-1]["rows"] == 3 and ended == [None]
