"""Every operator and stage on nulls, empties, long texts, ties, repeated rows,
empty tables and columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from foliant.llm import alignment, fill_middle, hmm_lm, jaccard_join, language_id, licenses, mixing, near_vectors, quality_cnn, quality_rules, secrets, sentencepieces, token_counts
from foliant.llm.common import durable

CLASH = ("_text", "text_", "h", "k", "n", "size", "score", "spans", "base", "bucket", "comp", "set_key", "row", "key", "mean")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(24)]
    texts += [None, "", "   \n\t ", texts[0], texts[0], "x " * 30_000, "y" * 30_000, "é漢😀 ▁ \0 a\n\nb", "password=abcdefgh12 AKIA" + "A" * 16]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, "no id here at all", "en", "s1", 17)]


@pytest.fixture(scope="module")
def tables(spark):
    full = spark.createDataFrame(rows(), SCHEMA)
    clash = full.select("*", *(F.lit(1).alias(c) for c in CLASH))
    return {"full": clash, "empty": spark.createDataFrame([], SCHEMA)}


def operators():
    yield "encode", lambda d: sentencepieces.encode(d), True
    yield "digest", lambda d: sentencepieces.encode(d, digest=True), True
    yield "count", lambda d: token_counts.count(d), True
    yield "join", lambda d: jaccard_join.join(d), True
    yield "secrets", lambda d: secrets.report(d, secrets.train(secrets.labelled(d))), True
    yield "redact", lambda d: secrets.redact(d, secrets.train(secrets.labelled(d))), True
    yield "language", lambda d: language_id.predict(d, language_id.train(d, F.lit(True))), True
    yield "lm", lambda d: hmm_lm.score(d, F.lit(True), rounds=1), True
    yield "cnn", lambda d: quality_cnn.classify(d, quality_cnn.Network().ready()), True
    yield "rules", lambda d: quality_rules.rules(d), True
    yield "mix", lambda d: mixing.mix(d), True
    yield "take", lambda d: mixing.take(d), False
    yield "fill", lambda d: fill_middle.report(d), True
    yield "filled", lambda d: fill_middle.restore(fill_middle.transform(d)), True
    yield "licenses", lambda d: licenses.report(d), True
    yield "notices", lambda d: licenses.find(d), False
    yield "alignment", lambda d: alignment.report(d), True


@pytest.mark.parametrize("which", ["full", "empty"])
@pytest.mark.parametrize("name,run,same", list(operators()), ids=[x[0] for x in operators()])
def test_operator(tables, which, name, run, same):
    got = run(tables[which]).collect()
    if same:
        assert len(got) == tables[which].count()
    if name == "join" and which == "full":
        by = {r["doc_id"]: r["component_id"] for r in got}
        assert by[27] == by[28] == by[0] == 0 and by[24] == 24 and by[25] == 25 and by[None] is None
    if name == "count" and which == "full":
        assert {r["doc_id"]: r["n_tokens"] for r in got}[24] == 0


@pytest.mark.parametrize("which", ["full", "empty"])
def test_pipeline_stages(spark, tables, which, tmp_path):
    docs = tables[which]
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == columns, name
        docs = durable(got)
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_vectors(spark):
    nan = float("nan")
    vecs = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [0.0, 1.0], 1), (11, [1e30, 1e28], 1), (12, [], 1), (13, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").withColumn("leaf", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(df).collect()}
    assert len(got) == len(vecs)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[11] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12, 13))
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0
