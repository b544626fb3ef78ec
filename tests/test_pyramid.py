"""Image levels as one table, against levels made one by one, and what a lookup reads."""

import math

import pytest
from pyspark.sql import functions as F

from lattica.functions.grid import tile_y
from lattica.operators import pyramid, raster
from lattica.session import scratch

IMAGES = "viewport string, year int, width int, height int, a double, c double, e double, f double"


def image(spark, viewport, width, height):
    return spark.range(width * height).select(
        F.lit(viewport).alias("viewport"), F.lit(2024).alias("year"), (F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"), F.col("id").alias("band")
    )


@pytest.fixture(scope="module")
def table(spark):
    images = spark.createDataFrame([("a", 2024, 333, 70, 0.001, -1.0, -0.001, 52.0), ("b", 2024, 64, 64, 0.01, 10.0, -0.01, 10.0)], IMAGES)
    both = image(spark, "a", 333, 70).unionByName(image(spark, "b", 64, 64)).unionByName(image(spark, "unknown", 4, 4))
    path = scratch(spark, "levels")
    pyramid.write_levels(pyramid.levels(both, images), path)
    return spark.read.parquet(path), pyramid.sizes(images)


@pytest.mark.parametrize("k", range(6))
def test_levels_as_one_by_one(spark, table, k):
    for viewport, width, height in (("a", 333, 70), ("b", 64, 64)):
        got = table[0].where((F.col("viewport") == viewport) & (F.col("level") == k)).select("col", "row", "band")
        want = raster.level(image(spark, viewport, width, height), width, height, k).select("col", "row", "band")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        size = table[1].where((F.col("viewport") == viewport) & (F.col("level") == k)).first()
        assert (size["width"], size["height"]) == (max(1, width >> k), max(1, height >> k))


def test_sizes_that_do_not_halve(spark):
    """A side of one pixel, and sides whose levels keep another pixel than a plain quotient."""
    images = spark.createDataFrame([("a", 2024, 1, 97, 1.0, 0.0, 1.0, 0.0)], IMAGES)
    got = pyramid.levels(image(spark, "a", 1, 97), images)
    for k in range(6):
        rows = {r["row"]: r["band"] for r in got.where(F.col("level") == k).collect()}
        h = max(1, 97 >> k)
        assert rows == {r: math.floor((r + 0.5) * (97 / h)) for r in range(h)}


def test_a_tile_reads_one_folder(spark, table):
    levels, sizes = table
    requests = spark.createDataFrame([("b", 2024, 8, 135, 121), ("b", 1999, 8, 135, 121), ("nowhere", 2024, 8, 135, 121), ("a", 2024, 8, 0, 0)], "viewport string, year int, z int, x long, y long")
    found = pyramid.tiles(levels, sizes, requests, 32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    (scan,) = {line[line.index("PartitionFilters: ") :].split("]")[0] for line in plan.splitlines() if "PartitionFilters: " in line}
    assert "year" in scan and "level" in scan and "= 3)" in scan  # Spark cuts the rest of the line off
    rows = found.collect()
    assert {(r["viewport"], r["year"]) for r in rows} == {("b", 2024)}  # other years, places and viewports are empty
    window = pyramid.windows(requests.where("viewport = 'b' and year = 2024"), sizes).first()
    assert window["level"] == 3
    want = {}
    for c in range(32):
        for r in range(32):
            col, row = math.floor((c + 0.5) * window["w"] / 32) + window["x0"], math.floor((r + 0.5) * window["h"] / 32) + window["y0"]
            if 0 <= col < 8 and 0 <= row < 8:
                want[c, r] = math.floor((row + 0.5) * 8) * 64 + math.floor((col + 0.5) * 8)
    assert want and {(r["tile_col"], r["tile_row"]): r["band"] for r in rows} == want


def test_morton_order(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (5, 3), (2**31 - 1, 2**31 - 1), (2**20 + 3, 7)]
    rows = spark.createDataFrame(pairs, "x int, y int").select("x", "y", pyramid.morton(F.col("x"), F.col("y")).alias("m")).collect()
    for r in rows:
        assert r["m"] == sum(((r["x"] >> k & 1) << 2 * k) | ((r["y"] >> k & 1) << 2 * k + 1) for k in range(31))


def test_bounds_of_the_full_level(table):
    rows = {r["viewport"]: r for r in pyramid.bounds(table[1]).collect()}
    assert (rows["b"]["west"], round(rows["b"]["south"], 9), round(rows["b"]["east"], 9), rows["b"]["north"]) == (10.0, 9.36, 10.64, 10.0)
    assert round(rows["b"]["center_lat"], 9) == 9.68


def test_tiles_meet_pixels_by_both_places(spark, table):
    """Windows smaller and larger than a tile, as pixel by pixel; no join is by one side alone, which pairs each pixel with every tile of its column."""
    levels, sizes = table
    at = lambda z, lon, lat: (z, math.floor((lon + 180) / 360 * 2**z), math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**z))
    asked = {at(z, lon, 51.96) for z in (8, 10, 12, 13, 14) for lon in (-0.9, -0.87, -0.7)}
    requests = spark.createDataFrame([("a", 2024, *x) for x in asked], "viewport string, year int, z int, x long, y long")
    found = pyramid.tiles(levels, sizes, requests, 8)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line and "(col#" in line]
    assert joins and all("(row#" in line for line in joins)
    held = {(r["level"], r["col"], r["row"]): r["band"] for r in levels.where("viewport = 'a'").collect()}
    want = {}
    for r in pyramid.windows(requests, sizes).collect():
        for c in range(8):
            for d in range(8):
                at = r["level"], math.floor((c + 0.5) * r["w"] / 8) + r["x0"], math.floor((d + 0.5) * r["h"] / 8) + r["y0"]
                if at in held:
                    want[r["z"], r["x"], r["y"], c, d] = held[at]
    assert len({k[0] for k in want}) > 3
    rows = [((r["z"], r["x"], r["y"], r["tile_col"], r["tile_row"]), r["band"]) for r in found.collect()]
    assert dict(rows) == want and len(rows) == len(want)


def test_map_tiles_at_and_beyond_the_poles(spark):
    """A grid that runs on past the south pole has numbered rows there, as by an exact inverse of sinh."""
    lats = [52.0, 0.0, -45.0, -85.0, -89.99, -90.0, -90.01, -236.0]
    got = [r["y"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lats)], "i int, lat double").orderBy("i").select(tile_y(F.col("lat"), F.lit(8)).alias("y")).collect()]
    assert got == [math.floor((1 - math.asinh(math.tan(math.radians(x))) / math.pi) / 2 * 2**8) for x in lats]
