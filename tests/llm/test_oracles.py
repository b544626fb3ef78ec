"""The SQL of the subpackage's queries on the smallest tables."""

import os

import duckdb
import pytest

from lattica.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_sql_of_decontamination_finds_short_items(spark, docs):
    """Items of fewer words than the window, which the tables have not."""
    con = duckdb.connect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "one two"), (2, "three"), (3, None), (4, " ".join((rows[9][1] or "x").split()[:20]))]
    for name, made, key in (("documents", rows, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", made)
    found = con.execute(queries.OP6_SQL)
    names = [d[0] for d in found.description]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r[x] for x in names) for r in decontaminate.decontaminate(docs, bench).collect()]
    want = found.fetchall()
    assert sum(r[names.index("n_items")] for r in want) >= 3
    assert sorted(map(str, got)) == sorted(map(str, want))
