"""The limiter against a plain simulation, as a batch and as a stream; event lines as a stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lattica.plans import evaluation, ingest
from lattica.streaming import events as ev


def _brute(rows, most, seconds):
    out, held = {}, {}
    for k, t, o in sorted(rows):
        mine = [x for x in held.get(k, []) if t - x < seconds]
        out[o] = len(mine) < most
        held[k] = [*mine, t] if out[o] else mine
    return out


def test_rate_limit_equals_simulation(spark):
    r = random.Random(1)
    rows = [(r.choice("abc" * 3 + "d"), r.randrange(5000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, s long, o long").select("k", "o", F.timestamp_seconds("s").alias("t"))
    got = ev.rate_limit(df, "k", "t", "o", 5, 600).collect()
    assert {x["o"]: x["allowed"] for x in got} == _brute(rows, 5, 600)
    assert all((x["retry_after"] == 0) == x["allowed"] and x["retry_after"] <= 600 for x in got)


def test_hot_key_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = [("a", i * 7, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, s long, o long").select("k", "o", F.timestamp_seconds("s").alias("t"))
    got = {x["o"]: x["allowed"] for x in ev.rate_limit(df, "k", "t", "o", 5, 600).collect()}
    assert got == _brute(rows, 5, 600)


def test_stream_of_requests(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=60 * i)) for i in range(8)] + [("b", start)]
    spark.createDataFrame(rows, "k string, t timestamp").write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    q = ev.stream_rate_limit(log, "k", "t").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("limited").groupBy("k", "allowed").count().collect()
    assert {(r["k"], r["allowed"]): r["count"] for r in got} == {("a", True): 5, ("a", False): 3, ("b", True): 1}


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text('{"event":"start"}\n{"event":"heartbeat"}\n{broken\n\n{"event":"progress","model":"nn","pct":10,"score":0.5}\n')
    q = ev.stream_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event"] for r in spark.table("lines").collect()) == ["progress", "start"]


def test_ingest_counts_from_the_corner(spark):
    rows = [("v", 2024, x, y, [float(x), float("nan")]) for x in range(4) for y in range(3)]
    p = spark.createDataFrame(rows, "viewport_id string, year int, px int, py int, emb array<double>")
    cut = ingest.rebased(p, 1, 1, 3, 3)
    assert sorted((r["idx"], r["px"], r["py"], r["emb"][1]) for r in cut.collect()) == [(0, 0, 0, 0.0), (1, 1, 0, 0.0), (2, 0, 1, 0.0), (3, 1, 1, 0.0)]
    coded, bounds = ingest.quantised_years(cut)
    assert sorted(r["q"] for r in coded.collect()) == [[0, 0], [0, 0], [255, 0], [255, 0]] and bounds.count() == 1
    assert ingest.failures(p).count() == 0
    assert ingest.failures(p.withColumn("emb", F.array(F.lit(0.0)))).count() == 1


def test_across_years_keeps_places(spark):
    rows = [(i, [float(i % 2), 1.0], i % 2) for i in range(20)]
    p = spark.createDataFrame(rows, "idx long, emb array<double>, label int")
    split = p.select("idx", F.when(F.col("idx") < 12, "train").otherwise("test").alias("split"))
    got = evaluation.across_years(p, p, split, "nn").collect()
    assert len(got) == 8 and all(r["label"] == r["prediction"] for r in got)
