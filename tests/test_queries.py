"""Registered queries against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lattica import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings")
#: DuckDB's names of the types that Spark's results have.
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _sorted(rows):
    rounded = [tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(rounded, key=lambda r: [(v is None, str(v)) for v in r])


def test_every_oracle_has_a_query():
    assert set(oracles.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(oracles.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert sorted(kinds) == sorted(df.columns)
    columns = sorted(df.columns)
    where = [[d[0] for d in found.description].index(c) for c in columns]
    want = _sorted([[r[i] for i in where] for r in found.fetchall()])
    assert _sorted([[r[c] for c in columns] for r in df.collect()]) == want
    types = {c: KINDS[t] for c, t in df.dtypes}
    assert {c: t for c, t in kinds.items() if t != types[c] and not t.startswith(("DECIMAL", "HUGEINT"))} == {}


def test_random_start_queries_have_all_rows(spark):
    for name in ("kmeans_clusters", "pca_scores"):
        df = queries.queries()[name](spark, SF)
        assert df.count() == df.select("idx").distinct().count() == 500


def test_name_rules(spark):
    given = spark.createDataFrame(queries.TEXTS, "email string, name string, css string")
    rows = {r["base"]: r.asDict() for r in queries.names(given).collect()}
    assert rows["nn"]["folder"] == "ab_c_at_d-e_org" and rows["nn"]["variant"] == 2 and rows["nn"]["red"] == 1.0
    assert rows["mlp"]["folder"] is None and rows["mlp"]["variant"] == 10
    assert not rows["Name With Space"]["valid"] and rows["Name With Space"]["red"] is None
    assert rows["rf"]["red"] == round(170 / 255, 6)


def test_model_scores_are_scores(spark):
    rows = {r["model"]: r["score"] for r in queries.queries()["model_scores"](spark, SF).collect()}
    assert set(rows) == {"nn", "rf", "mlp", "rf_reg"} and all(0 <= rows[m] <= 1 for m in ("nn", "rf", "mlp")) and rows["rf_reg"] > 0
