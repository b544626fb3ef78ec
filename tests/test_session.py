"""Sides that are small enough to be broadcast."""

from pyspark.sql import functions as F

from lattica import session as session_module
from lattica.session import small


def test_small_sides_are_fetched_once(spark):
    df = spark.range(50).select("id", F.array(F.col("id").cast("double"), F.lit(None)).alias("v"), F.struct(F.lit("x").alias("s")).alias("t"), F.timestamp_seconds("id").alias("at"))
    held = small(df)
    assert held.schema.simpleString() == df.schema.simpleString() and held.orderBy("id").collect() == df.orderBy("id").collect()
    assert "LocalTableScan" in held._jdf.queryExecution().toString() or "LocalRelation" in held._jdf.queryExecution().toString()
    assert small(df.limit(0)).collect() == []


def test_larger_sides(spark):
    big = spark.range(5_000).select("id", F.sequence(F.lit(0), F.lit(60)).alias("v"))
    assert "hint" in small(big)._jdf.queryExecution().toString().lower()  # beyond 1 MB: broadcast from its own plan
    assert small(big, 100) is big


def test_a_cluster_needs_a_shared_folder():
    assert session_module._one_machine("local") and session_module._one_machine("local[8]")
    assert not session_module._one_machine("local-cluster[3,2,3000]") and not session_module._one_machine("yarn")
