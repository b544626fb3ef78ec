"""Trained codebooks, made-up truth, neighbourhoods over several tiles, and the reader that chooses a table."""

import os

import numpy as np
import pytest

from lattica import queries
from lattica.operators import cluster, codebook
from lattica.sources.tables import read_vectors

SF = "/root/testdata/sf0.001"


def test_pixels_have_the_nearest_code_and_few_vectors_are_kept(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=3)]) for i in range(80)] + [(100 + i, 2, [1.0, float(i % 2), 0.0]) for i in range(9)]
    tiled = spark.createDataFrame(rows, "idx long, tile int, emb array<double>")
    codes, first, second = codebook.train_stages(tiled, {"k": 4, "k2": None, "metric": "L2"})
    book = {(r["tile"], r["code"]): np.array(r["vec"]) for r in first.collect()}
    assert second is None and sorted(c for t, c in book if t == 2) == [0, 1]
    found = {r["idx"]: r["i1"] for r in codes.collect()}
    assert len(found) == len(rows)
    for idx, tile, v in rows:
        d = {c: ((np.array(v) - m) ** 2).sum() for (t, c), m in book.items() if t == tile}
        assert d[found[idx]] == pytest.approx(min(d.values()))


def test_neighbourhood_crosses_tiles(spark):
    at = {(x, y): [float(100 * x + y), float(x - y)] for x in range(11) for y in range(9) if (x, y) != (4, 4)}
    rows = [(i, x, y, v) for i, ((x, y), v) in enumerate(at.items())]
    p = spark.createDataFrame(rows, "idx long, px int, py int, emb array<double>")
    for reach in (1, 2):
        found = {r["idx"]: r["features"] for r in cluster.neighbourhood(p, reach, tile=4).collect()}
        steps = range(-reach, reach + 1)
        want = {i: [e for dy in steps for dx in steps for e in at.get((x + dx, y + dy), v)] for i, x, y, v in rows}
        assert found == want


def test_vectors_that_are_nowhere(spark, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        read_vectors(spark, str(tmp_path), "v1", 2024)


def test_all_zero_vectors(spark, tmp_path):
    rows = [("v1", 2024, i, i, 0, [0.0, 0.0]) for i in range(3)]
    spark.createDataFrame(rows, "viewport_id string, year int, idx long, px int, py int, emb array<double>").write.parquet(f"{tmp_path}/pixel")
    with pytest.raises(ValueError, match="zero"):
        read_vectors(spark, str(tmp_path), "v1", 2024)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_random_truth_scores_near_chance_and_clusters_do_not(spark):
    score = {r["kind"]: r["accuracy"] for r in queries.queries()["truth_sanity"](spark, SF).collect()}
    assert score["random"] < 0.2 and score["clusters"] > 3 * score["random"]
