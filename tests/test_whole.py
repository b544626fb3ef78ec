"""Queries that run over the whole table, against the SQL without its cuts to some of the rows."""

import os

import duckdb
import numpy as np
import pytest

from lattica import oracles, queries
from lattica.model import pixels
from lattica.operators import cluster

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_no_sql_cuts_rows_by_id():
    """Exports, images and graphs have a row for each pixel, whatever the size of the table."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    n = con.execute("SELECT count(*) FROM embeddings").fetchone()[0]
    sizes = {"csv_export": n, "geojson_export": n, "kml_export": n, "geojson_import": 2 * n, "enlarged": 9 * n, "change_colours": n, "knn_graph": 5 * -(-n // 20)}
    for name, want in sizes.items():
        assert con.execute(f"SELECT count(*) FROM ({oracles.oracle_sql()[name]})").fetchone()[0] == want, name


def test_knn_graph_takes_every_twentieth_pixel(spark):
    vectors = {r["idx"]: np.array(r["emb"]) for r in pixels(spark, SF).select("idx", "emb").collect()}
    want = {}
    for s in (i for i in vectors if i % 20 == 0):
        near = sorted((float(((v - vectors[s]) ** 2).sum()), i) for i, v in vectors.items() if i != s)[:5]
        want |= {(s, rank + 1): (i, d) for rank, (d, i) in enumerate(near)}
    found = queries.queries()["knn_graph"](spark, SF).collect()
    assert len(found) == len(want) == 125
    assert all(want[r["source"], r["rank"]] == (r["idx"], pytest.approx(r["d2"], abs=2e-6)) for r in found)


def test_knn_graph_over_several_blocks_with_ties(spark):
    points = [(i, [float(i // 3 % 200), float(i % 2)]) for i in range(900)]
    p = spark.createDataFrame(points, "idx long, emb array<double>")
    found = {(r["source"], r["rank"], r["idx"]) for r in cluster.knn_graph(p, p.where("idx % 2 = 0"), 4).collect()}
    want = set()
    for s, v in points[::2]:
        near = sorted(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2, i) for i, w in points if i != s)[:4]
        want |= {(s, rank + 1, i) for rank, (_, i) in enumerate(near)}
    assert found == want
