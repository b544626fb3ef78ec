"""Lookup and search on tiny literal grids, and the property that thresholds cut cached distances rightly."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.functions.vec import literal
from lattica.model import Grid
from lattica.operators import cluster, evaluate, geom, quant, raster, search

GRID = Grid(width=3, a=0.01, e=-0.01, c=-1.0, f=52.0)
PIXELS = "idx long, px int, py int, emb array<double>"


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(0, 0, 0, [1.0, 0.0, 0.0, 0.0]), (1, 1, 0, [0.0, 1.0, 0.0, 0.0]), (2, 2, 0, [1.0, 0.0, 0.0, 0.0])], PIXELS)


@pytest.mark.parametrize(("t", "n"), [(0.0, 2), (2.0, 3)])
def test_range(row, t, n):
    found = search.range_search(row, literal([1, 0, 0, 0]), t, GRID).collect()
    assert len(found) == n and sum(r["distance"] == 0 for r in found) == 2


def test_multi_and_empty(spark, row):
    q = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], 0.0), ([0.0, 1.0, 0.0, 0.0], 0.0)], "emb array<double>, t2 double")
    assert search.multi_search(row, q).count() == 3
    assert search.multi_search(row, q.limit(0)).count() == 0
    assert search.min_sq_distances(row, q.limit(0).select("emb")).count() == 0


def _lcg(n):
    s, out = 42, []
    for _ in range(n):
        s = (s * 1103515245 + 12345) & 0x7FFFFFFF
        out.append(s % 256 / 255 * 10 - 5)
    return out


@pytest.mark.parametrize(("n", "dims", "k"), [(20, 8, 1), (60, 32, 5)])
def test_cut_distances_equal_direct_search(spark, n, dims, k):
    v = _lcg((n + k) * dims)
    rows = [(i, i % 50, i // 50, v[i * dims : (i + 1) * dims]) for i in range(n)]
    p = spark.createDataFrame(rows, PIXELS)
    q = spark.createDataFrame([(v[(n + j) * dims : (n + j + 1) * dims],) for j in range(k)], "emb array<double>")
    d = search.min_sq_distances(p, q).persist()
    for t in (0.5, 5.0, 15.0, 30.0, 60.0):
        direct = {r["idx"] for r in search.multi_search(p, q.withColumn("t2", F.lit(t * t))).collect()}
        assert {r["idx"] for r in search.matches(d, t).collect()} == direct
        for r in rows:
            near = min(sum((a - b) ** 2 for a, b in zip(r[3], x["emb"])) for x in q.collect()) <= t * t
            assert (r[0] in direct) == near
        if n > 20:
            break


def test_extract_tries_neighbours_in_order(spark):
    g = Grid(width=2, a=0.01, e=-0.01, c=-1.0, f=52.0)
    p = spark.createDataFrame([(v, v % 2, v // 2, [v * 1000.0 + d for d in range(128)]) for v in range(4)], PIXELS)
    probes = spark.createDataFrame([("a", 52.0, -1.0), ("b", 52.0, -0.99), ("c", 51.985, -1.0), ("d", 10.0, 10.0)], "probe string, lat double, lon double")
    found = {r["probe"]: r["emb"] for r in search.extract(p, probes, g).collect()}
    assert found["a"][0] == 0 and found["a"][127] == 127 and found["b"][0] == 1000 and found["c"][0] == 2000 and "d" not in found


CONCAVE = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (5.0, 5.0), (5.0, 10.0), (0.0, 10.0)]


@pytest.mark.parametrize(("vertices", "x", "y", "want"), [
    ([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], 5, 5, True), ([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], 15, 5, False),
    ([(0.0, 0.0), (10.0, 0.0), (5.0, 10.0)], 5, 3, True), ([(0.0, 0.0), (10.0, 0.0), (5.0, 10.0)], 0, 10, False), (CONCAVE, 2, 2, True), (CONCAVE, 7, 2, True), (CONCAVE, 7, 7, False), (CONCAVE, -1, 5, False),
])
def test_contains(spark, vertices, x, y, want):
    v = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in vertices))
    assert spark.range(1).select(geom.contains(F.lit(float(x)), F.lit(float(y)), v)).first()[0] == want


def test_rasterise_and_short_polygon(spark):
    p = spark.range(25).select(F.col("id").alias("idx"), (F.col("id") % 5).cast("int").alias("px"), F.floor(F.col("id") / 5).cast("int").alias("py"))
    kind = "polygon int, vertices array<struct<x:double,y:double>>"
    square = spark.createDataFrame([(1, [{"x": 1.0, "y": 1.0}, {"x": 3.0, "y": 1.0}, {"x": 3.0, "y": 3.0}, {"x": 1.0, "y": 3.0}]), (2, [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 4.0}])], kind)
    found = {(r["polygon"], r["px"], r["py"]) for r in geom.rasterise(p, square).collect()}
    assert found == {(1, 1, 1), (1, 2, 1), (1, 1, 2), (1, 2, 2)}


def test_runs(spark):
    cells = spark.createDataFrame([("a", x, y) for x, y in ((1, 0), (2, 0), (2, 0), (4, 0), (0, 1))], "label string, px int, py int")
    assert sorted(map(tuple, geom.run_rectangles(cells).collect())) == [("a", 0, 1, 1, 2), ("a", 1, 0, 3, 1), ("a", 4, 0, 5, 1)]


@pytest.mark.parametrize(("height", "width", "grid", "want"), [
    (33, 32, [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4), (2, 0, 20), (2, 1, 30)], {(0, 0): 1, (16, 0): 3, (17, 0): 20, (32, 31): 30, (16, 31): 4}),
    (17, 16, [(0, 0, 1), (1, 0, 2)], {(0, 0): 1, (1, 0): 2, (16, 15): 2}),
])
def test_assemble_last_tile_wins(spark, height, width, grid, want):
    tiles = spark.createDataFrame([(r, c, k, [v] * 256) for k, (r, c, v) in enumerate(grid)], "row int, col int, ord int, codes array<int>")
    found = {(r["py"], r["px"]): r["code"] for r in quant.assemble(tiles, height, width, 16).collect()}
    assert len(found) == height * width and all(found[k] == v for k, v in want.items())


def test_constant_dimension_round_trips(spark):
    p = spark.createDataFrame([(0, 0, 0, [3.0, 1.0]), (1, 1, 0, [3.0, 2.0])], PIXELS)
    assert [r["decoded"] for r in quant.decoded(quant.quantise_pixels(p)).orderBy("idx").collect()] == [[3.0, 1.0], [3.0, 2.0]]


def test_kmeans_puts_every_pixel_on_its_nearest_centre(spark):
    p = spark.createDataFrame([(i, i % 5, i // 5, [float(i % 2 * 10 + i % 3), float(i % 2)]) for i in range(60)], PIXELS)
    found, centres = cluster.kmeans(p, 2)
    a = cluster.assign(p, centres).select("idx", F.col("cluster").alias("own"))
    assert found.join(a, "idx").where("cluster <> own").count() == 0
    assert sum(r["n"] for r in cluster.cluster_sizes(found).collect()) == 60
    labels = found.withColumn("label", F.col("cluster"))
    assert evaluate.f1_summary(evaluate.cross_validated(labels.select("idx", "emb", "label"), "nn", 3)).first()["macro_f1"] == 1.0


def test_components_are_orthonormal(spark):
    p = spark.createDataFrame([(i, i, 0, [float(i), float(i * i % 7), float(i % 3), 5.0]) for i in range(50)], PIXELS)
    scores, loadings, share = cluster.principal_components(p, 3)
    for i, v in enumerate(loadings):
        for j, w in enumerate(loadings):
            assert abs(sum(a * b for a, b in zip(v, w)) - (i == j)) < 1e-9
    assert share == sorted(share, reverse=True)
    assert abs(scores.select(F.avg(F.col("pc")[0])).first()[0]) < 1e-9


def test_window_and_level_sizes(spark):
    image = spark.range(12).select((F.col("id") % 4).cast("int").alias("px"), F.floor(F.col("id") / 4).cast("int").alias("py"))
    assert raster.level(image, 4, 3, 1).count() == 2
    assert raster.window(image, Grid(4, 0.01, -0.01, -1.0, 52.0), 10, 10, 10, 10).count() == 0


def test_metrics_of_unseen_class_are_zero(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (2, 2)], "label int, prediction int")
    s = {r["class"]: (r["support"], r["precision"], r["recall"], round(r["f1"], 4)) for r in evaluate.class_scores(p).collect()}
    assert s == {0: (2, 1.0, 0.5, 0.6667), 1: (0, 0.0, 0.0, 0.0), 2: (1, 1.0, 1.0, 1.0)}


def test_config_and_types(spark):
    good = {"$schema": "x", "shapefile": "a.zip", "fields": [{"name": "habitat"}], "classifiers": {"nn": {}, "rf": {}}}
    assert evaluate.check_config(good) == []
    assert evaluate.check_config({**good, "classifiers": {"svm": {}, "unet": {}}}) == ["unknown model svm", "unet needs neighbourhoods"]
    assert len(evaluate.check_config({"fields": [{}]})) == 3
    truth = spark.createDataFrame([("wood", 1.5 + i, i % 3) for i in range(10)], "habitat string, carbon double, code int")
    assert [evaluate.field_type(truth, f) for f in ("habitat", "carbon", "code")] == ["classification", "regression", "classification"]
    events = evaluate.dry_run(truth, [{"name": "habitat"}, {"name": "none"}], [2024], ["nn"])
    assert [e["event"] for e in events] == ["dry_run", "error"] and events[0]["unique_values"] == 1


def test_passes_over_blocks_agree(spark):
    """Few blocks at a time, or all at once: the same neighbours, without a cartesian product."""
    r = random.Random(5)
    v = [r.uniform(-5, 5) for _ in range(90 * 4)]
    p = spark.createDataFrame([(i, i % 10, i // 10, v[i * 4 : i * 4 + 4]) for i in range(90)], PIXELS)
    found = search.nearest_rows(p, p.where("idx < 40"), 3, block=8, sent=2)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    once = search.nearest_rows(p, p.where("idx < 40"), 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, once.collect()))
    want = {(a, b) for a in range(40) for _, b in sorted((sum((x - y) ** 2 for x, y in zip(v[a * 4 : a * 4 + 4], v[b * 4 : b * 4 + 4])), b) for b in range(90))[:3]}
    assert {(r["source"], r["idx"]) for r in found.collect()} == want


def test_many_query_vectors(spark):
    """More vectors than a block holds are found as well as few."""
    r = random.Random(6)
    v = [r.uniform(-5, 5) for _ in range(600 * 2)]
    p = spark.createDataFrame([(i, i % 30, i // 30, v[i * 2 : i * 2 + 2]) for i in range(600)], PIXELS)
    q = p.where("idx % 2 = 0").select("emb", F.lit(0.01).alias("t2"))
    want = {i for i in range(600) if any((v[2 * i] - v[2 * j]) ** 2 + (v[2 * i + 1] - v[2 * j + 1]) ** 2 <= 0.01 for j in range(0, 600, 2))}
    assert {r["idx"] for r in search.multi_search(p, q).collect()} == want
    assert {r["idx"] for r in search.min_sq_distances(p, q.select("emb")).where("d2 = 0").collect()} >= set(range(0, 600, 2))
