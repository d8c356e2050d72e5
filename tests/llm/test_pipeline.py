"""Every stage of the pipeline against a plain version of it, on what the stage
before kept."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from foliant.llm import mixing, quality_cnn, secrets
from foliant.llm.common import durable
from foliant.llm.pieces import file_of, library
from foliant.llm.sentencepieces import MODEL
from tests.llm.test_results import WORD, components_by_brute, merged_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def start(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twin = docs.where("doc_id < 6")
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    more = spark.createDataFrame([(9001, a, "en", "s", 0), (9001, b, "en", "s", 0), (9000, a + " more", "en", "s", 0), (9002, "", "en", "s", 0), (None, b + " x", "en", "s", 0), (9003, None, "en", None, 0)], docs.schema)
    return durable(docs.union(twin).union(twin.withColumn("doc_id", F.col("doc_id") + 5000)).union(more))


def bag(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_quality_keeps_what_the_network_accepts(spark, start):
    got = P.quality(spark, start, SF)
    net = quality_cnn.train(start, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    rows = [(r["doc_id"], r["text"]) for r in start.collect()]
    b = [(t or "").encode() for _, t in rows]
    p = net.score(np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, b)))]))
    assert bag(got) == Counter(r for r, x in zip(rows, p, strict=True) if x >= quality_cnn.CUT)


def test_one_row_of_each_class_stays(spark, start):
    rows = [(r["doc_id"], r["text"]) for r in start.collect()]
    _, comp = components_by_brute([t for _, t in rows])
    classes = {}
    for (i, t), c in zip(rows, comp, strict=True):
        classes.setdefault(c, []).append((i is None, i or 0, i, t))
    got = bag(P.near_duplicates(spark, start, SF))
    left = Counter(rows)
    for members in classes.values():
        if not WORD.search(members[0][3] or ""):
            continue
        stays = [m for m in members if m[:2] == min(x[:2] for x in members)]
        kept = [(m[2], m[3]) for m in stays if (m[2], m[3]) in got]
        assert len(set(kept)) == 1 and got[kept[0]] == 1
        for m in members:
            left.pop((m[2], m[3]), None)
        left[kept[0]] = 1
    assert got == left


def test_secrets_are_masked_and_the_rest_stays(spark, start):
    ratios = secrets.train(secrets.labelled(start))
    keyed = start.where("doc_id is not null").dropDuplicates(["doc_id"])
    spans = {r["doc_id"]: r["spans"] for r in secrets.report(keyed, ratios).collect()}
    got = {r["doc_id"]: r["text"] for r in secrets.redact(keyed, ratios).collect()}
    for r in keyed.collect():
        t, want, at = r["text"], "", 0
        if t is None:
            assert got[r["doc_id"]] is None
            continue
        for a, b in merged_spans([tuple(map(int, s.split(":")[1:])) for s in spans[r["doc_id"]].split(",") if s]):
            want, at = want + t[at:a] + "[secret]", b
        assert got[r["doc_id"]] == want + t[at:]
    whole = P.mask_secrets(spark, start, SF)
    assert whole.columns == start.columns and whole.count() == start.count()
    assert all(r["n_chars"] == len(r["text"]) for r in whole.where("text is not null").collect())


def test_mix_takes_what_is_planned(spark, start):
    plan = Counter()
    for r in mixing.mix(start).collect():
        if r["size"]:
            plan[r["doc_id"]] += r["taken"]
    taken = Counter()
    for r in P.mix(spark, start, SF).collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert +plan == +taken


def test_encoding_is_the_librarys(spark, start):
    sp = library(file_of(MODEL))
    texts = Counter((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in start.collect())
    assert Counter((r["doc_id"], tuple(r["pieces"])) for r in P.encode(spark, start, SF).collect()) == texts
