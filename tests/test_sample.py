"""Samples by group, vectors that are not there, and weights of a neighbour graph."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import cluster, codebook, evaluate, search
from lattica.operators.sample import hash_order, lowest
from lattica.session import small


def test_lowest_as_by_sorting(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(r.choice(["a", "b", "b", "b", "c", None]), k // 2, k) for k in range(4000)], "g string, id long, v int").repartition(4)
    wanted = spark.createDataFrame([("a", 100), ("b", 1), ("c", 10_000), ("d", 5)], "g string, wanted int")
    got = lowest(rows, ["g"], wanted, "id", 7, "at").collect()
    h = {(x["g"], x["id"], x["v"]): (x["h"], x["id"]) for x in rows.withColumn("h", hash_order("id", 7)[0]).collect()}
    for g, n in (("a", 100), ("b", 1), ("c", 10_000)):
        mine = sorted(v for k, v in h.items() if k[0] == g)
        kept = [x for x in got if x["g"] == g]
        assert sorted(h[x["g"], x["id"], x["v"]] for x in kept) == mine[:n]
        assert sorted(x["at"] for x in kept) == list(range(1, len(kept) + 1))
    assert {x["g"] for x in got} == {"a", "b", "c"}


def test_no_window_sorts_a_class(spark):
    """What a class's window ranks is bounded by its last bucket."""
    rows = spark.range(3000).select(F.col("id").alias("idx"), (F.col("id") % 3).cast("int").alias("label"))
    found = evaluate.stratified(rows, 300, "equal")
    assert found.groupBy("label").count().orderBy("label").collect() == [(0, 100), (1, 100), (2, 100)]
    for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "row_number" not in line or "__hash" in line
    ranked = rows.withColumn("h", F.xxhash64("idx", F.lit(42)))
    want = {x["idx"] for k in range(3) for x in ranked.where(F.col("label") == k).orderBy("h", "idx").limit(100).collect()}
    assert {x["idx"] for x in found.collect()} == want


def test_vectors_that_are_not_there(spark):
    rows = [(k, None if k == 3 else [] if k == 4 else [float(k), None] if k == 5 else [float(k), math.nan] if k == 6 else [float(k), 0.0]) for k in range(70)]
    p = spark.createDataFrame(rows, "idx long, emb array<double>")
    found = {(r["source"], r["rank"]): r["idx"] for r in search.nearest_rows(p, p, 2).collect()}
    assert {s for s, _ in found} == set(range(70)) - {3, 4, 5, 6} and found[2, 1] == 2 and found[7, 2] == 8
    assert search.nearest_rows(p.where("idx = 3"), p, 2).collect() == []


def test_weights_sum_to_the_logarithm(spark):
    r = random.Random(2)
    p = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(200)], "idx long, emb array<double>")
    found = cluster.fuzzy_weights(cluster.knn_graph(p, p, 10))
    rows = found.groupBy("source").agg(F.sum("weight").alias("s"), F.max("weight").alias("m")).collect()
    assert len(rows) == 200 and all(abs(x["s"] - math.log2(10)) < 1e-9 and x["m"] == 1.0 for x in rows)
    directed = {(x["source"], x["idx"]): x["weight"] for x in found.collect()}
    union = {(x["a"], x["b"]): x["weight"] for x in cluster.fuzzy_union(found).collect()}
    for (a, b), w in union.items():
        x, y = directed.get((a, b), 0.0), directed.get((b, a), 0.0)
        assert a < b and abs(w - (x + y - x * y)) < 1e-12
    assert {(min(e), max(e)) for e in directed} == set(union)


def test_copies_have_full_weights(spark):
    graph = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.0), (1, 4, 0.0)], "source long, idx long, d2 double")
    assert {r["weight"] for r in cluster.fuzzy_weights(graph).collect()} == {1.0}


@pytest.mark.parametrize(("rows", "most", "size", "sent"), [(10, 10, 1 << 20, True), (11, 10, 1 << 20, False), (10, 100, 2000, False), (0, 5, 100, True)])
def test_small_is_bounded_by_rows_and_bytes(spark, rows, most, size, sent):
    df = spark.range(rows).select("id", F.array_repeat(F.col("id").cast("double"), 100).alias("id"))
    found = small(df, most, size)
    assert found.columns == ["id", "id"] and found.count() == rows
    assert ("ResolvedHint" in found._jdf.queryExecution().analyzed().toString()) == sent


def test_codebooks_as_before(spark):
    r = random.Random(3)
    tiled = spark.createDataFrame([(k % 2, k, [r.random(), r.random()]) for k in range(400)], "tile int, idx long, emb array<double>")
    book = codebook.train(tiled, 4, per_code=20)
    assert book.groupBy("tile").count().orderBy("tile").collect() == [(0, 4), (1, 4)]
