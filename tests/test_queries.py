"""Every query with oracle SQL against DuckDB on the smallest tables, and the
registry's shape."""

import hashlib
import os
import unicodedata

import duckdb
import pytest

from foliant.plans import registry
from foliant.plans.base import FIXTURES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str([show(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_fixture(spark, duck, name):
    made, sql = FIXTURES[name]
    got, want = made(spark, SF), duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_project_list_all_has_every_project(spark, duck):
    got = registry.QUERIES["project_list_all"](spark, SF).collect()
    want = duck.execute("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey").fetchall()
    assert len(want) > 100
    assert [(r["pos"], r["o_orderkey"]) for r in sorted(got, key=lambda r: r["pos"])] == [(i, k) for i, (k,) in enumerate(want, 1)]


def test_duplicate_keys_and_sets_of_all_customers(spark, duck):
    column = lambda sql: {r[0] for r in duck.execute(sql).fetchall()}
    keys = {int(r["k"]) for r in registry.QUERIES["duplicate_keys"](spark, SF).collect()}
    few = column("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12")
    assert few and few <= keys and not keys & column("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
    customers = column("SELECT c_custkey FROM customer")
    sides = registry.QUERIES["shared_key_sets"](spark, SF).collect()
    assert {r["side"] for r in sides} == {"shared", "left", "right"} and customers <= {r["k"] for r in sides}
    assert customers <= {r["k"] for r in registry.QUERIES["priority_union_keys"](spark, SF).collect()}


def test_nfkc_heading_digests_whole_texts(spark, tmp_path):
    texts = ["x" * 80 + "\n第１２章　ﬁn", "a" * 100, "第１章\n" + "é" * 200 + "Ⅷ", "e\u0301" * 60, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["digest"] for r in registry.QUERIES["nfkc_heading"](spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.md5(unicodedata.normalize("NFKC", t).encode()).hexdigest()
    assert got == {i: t if t is None else digest(t) for i, t in enumerate(texts)}


def test_pieces_keep_the_text(spark):
    got = registry.QUERIES["text_split_budget"](spark, SF)
    assert got.where("longest > 1000").count() == 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
