"""What becomes of point requests, and where their pixels come from."""

from pyspark.sql import functions as F

from lattica.operators import fetch
from lattica.session import scratch

REGISTRY = "tile int, west double, south double, east double, north double, origin struct<lon:double,lat:double,dx:double,dy:double>, state string"


def registry(spark):
    new = (-0.014, 50.081, 0.00009, -0.00009)
    rows = [(1, 0.0, 50.0, 2.5, 53.0, new, "ready"), (2, 2.5, 50.0, 4.0, 53.0, None, "ready"), (3, 4.0, 50.0, 5.0, 53.0, new, "slow"), (4, 5.0, 50.0, 6.0, 53.0, new, "down"), (9, 0.0, 50.0, 2.5, 53.0, None, "ready")]
    return spark.createDataFrame(rows, REGISTRY)


def asked(spark):
    rows = [("new", 52.2099, 0.1823), ("old", 52.0, 3.0), ("slow", 51.0, 4.5), ("down", 51.0, 5.0), ("sea", 10.0, 0.5), ("edge", 53.0, 1.0), ("north", 91.0, 0.0), ("none", None, 1.0), ("nan", float("nan"), 1.0), ("wide", 0.0, 180.5)]
    return spark.createDataFrame(rows, "point string, lat double, lon double")


def test_kinds_of_failure_are_told_apart(spark):
    found = {r["point"]: r for r in fetch.outcomes(asked(spark), registry(spark), 2.0, 1.0).collect()}
    assert {k: r["status"] for k, r in found.items()} == {
        "new": "ok", "old": "ok", "slow": "timed out", "down": "failed", "sea": "no coverage", "edge": "no coverage", "north": "bad request", "none": "bad request", "nan": "bad request", "wide": "bad request",
    }
    assert {k for k, r in found.items() if r["status"] in fetch.RELEASED} == {"slow", "down"}
    assert found["none"]["west"] is None and found["sea"]["west"] is not None


def test_origin_and_box_go_with_the_answer(spark):
    found = {r["point"]: r for r in fetch.outcomes(asked(spark), registry(spark), 2.0, 1.0).collect()}
    assert tuple(found["new"]["origin"]) == (-0.014, 50.081, 0.00009, -0.00009) and found["new"]["tile"] == 1
    assert abs(found["new"]["north"] - found["new"]["south"] - 1 / 111.32) < 1e-9


def test_old_tiles_have_no_origin(spark):
    found = {r["point"]: r for r in fetch.outcomes(asked(spark), registry(spark), 2.0, 1.0).collect()}
    assert found["old"]["status"] == "ok" and found["old"]["origin"] is None and found["slow"]["origin"] is None


def test_pixels_of_the_tile_alone(spark):
    pixels = spark.range(4000).select((F.col("id") % 4 + 1).cast("int").alias("tile"), (F.lit(52.2) + (F.col("id") % 50) * 0.001).alias("lat"), (F.lit(0.17) + (F.col("id") % 40) * 0.001).alias("lon"), "id")
    path = scratch(spark, "tiles")
    pixels.write.partitionBy("tile").parquet(path)
    found = fetch.outcomes(asked(spark), registry(spark), 2.0, 1.0)
    box = found.where("point = 'new'").first()
    got = fetch.fetched(found, spark.read.parquet(path))
    want = pixels.where((F.col("tile") == 1) & F.col("lat").between(box["south"], box["north"]) & F.col("lon").between(box["west"], box["east"]))
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()) and want.count() > 0
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    assert fetch.fetched(found.limit(0), spark.read.parquet(path)).collect() == []
