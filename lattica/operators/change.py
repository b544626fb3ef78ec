"""Comparison of two years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import l2sq
from ..session import stored
from .quantile import quantiles

BINS = ("Stable", "Minor change", "Moderate change", "Major change")


def change(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distance of each pixel's vectors in two years on the same grid."""
    later = second.select("px", "py", F.col("emb").alias("emb2"))
    return first.join(later, ["px", "py"]).select("idx", "px", "py", F.sqrt(l2sq("emb", "emb2")).alias("distance"))


def change_stats(changes: DataFrame) -> DataFrame:
    held = stored(changes.select("distance"))
    return held.agg(
        F.count(F.lit(1)).alias("matched"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"),
        F.avg("distance").alias("mean_distance"), F.lit(median(held)).cast("double").alias("median_distance"),
    )


def median(changes: DataFrame) -> float | None:
    """The exact median distance; null and NaN are passed over."""
    return quantiles(changes, {"distance": [0.5]})["distance"][0]


def change_bins(changes: DataFrame) -> DataFrame:
    """Counts of the four bins around the median, empty ones too."""
    spark = changes.sparkSession
    changes = stored(changes.select("distance"))
    middle = F.lit(median(changes)).cast("double").alias("m")
    one = F.broadcast(changes.agg(middle, F.max("distance").alias("top"), F.count(F.lit(1)).alias("total")))
    bin_ = F.when(F.col("distance") < F.col("m") * 0.5, 0).when(F.col("distance") < F.col("m"), 1).when(F.col("distance") < F.col("m") * 1.5, 2).otherwise(3)
    counted = changes.crossJoin(one).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame(list(enumerate(BINS)), "bin int, label string")
    edge = lambda k: F.col("m") * (0.5 * k)
    out = F.broadcast(names).crossJoin(one).join(counted, "bin", "left")
    return out.select(
        "bin", "label", edge(F.col("bin")).alias("lo"), F.when(F.col("bin") == 3, F.col("top")).otherwise(edge(F.col("bin") + 1)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total") * 100).alias("pct"),
    )
