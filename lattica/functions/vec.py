"""Vector expressions over arrays of doubles; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def l2sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def once(x: Column) -> Column:
    """``x`` computed in a step of its own, so that a filter on it does not make it twice."""
    return F.explode(F.array(x))


def dequantise(q: Column | str, low: Column | str, high: Column | str) -> Column:
    """Values of codes 0..255 between each dimension's bounds."""
    scale = F.zip_with(low, high, lambda x, y: (y - x) / 255.0)
    return F.zip_with(F.zip_with(q, scale, lambda c, s: c * s), low, lambda v, x: v + x)


def quantise(v: Column | str, low: Column | str, high: Column | str, nearest: bool = False) -> Column:
    """Codes 0..255 of a vector, cut or rounded half up; a dimension without extent has code 0."""
    span = F.zip_with(low, high, lambda x, y: F.when(y > x, y - x).otherwise(1.0))
    unit = F.zip_with(F.zip_with(v, low, lambda x, y: x - y), span, lambda x, s: x / s * 255.0)
    return F.transform(unit, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x + 0.5 if nearest else x).cast("int"))))


def by_dimension(df: DataFrame, *keys: str, vector: str = "emb") -> DataFrame:
    """One row per key and dimension (from 0): dim, value."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "value"))


def gathered(df: DataFrame, *keys: str, value: str = "value", name: str = "emb") -> DataFrame:
    """The opposite of by_dimension(); a group has one row for each dimension."""
    held = F.array_sort(F.collect_list(F.struct("dim", value)))
    return df.groupBy(*keys).agg(F.transform(held, lambda x: x[value]).alias(name))


def bounds(df: DataFrame, *keys: str) -> DataFrame:
    """Arrays low and high of each dimension's extrema, per key; NaN counts as 0."""
    dims = by_dimension(df, *keys).withColumn("value", F.nanvl("value", F.lit(0.0)))
    each = dims.groupBy(*keys, "dim").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    held = F.array_sort(F.collect_list(F.struct("dim", "low", "high")))
    return each.groupBy(*keys).agg(F.transform(held, lambda x: x["low"]).alias("low"), F.transform(held, lambda x: x["high"]).alias("high"))


def mean_vector(df: DataFrame, *keys: str) -> DataFrame:
    """Mean of each dimension, per key, with the number of vectors; none for an empty set."""
    each = by_dimension(df, *keys).groupBy(*keys, "dim").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    held = F.array_sort(F.collect_list(F.struct("dim", "value")))
    return each.groupBy(*keys).agg(F.transform(held, lambda x: x["value"]).alias("emb"), F.max("n").alias("n"))
