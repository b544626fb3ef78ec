"""Exact quantiles of columns of any length, by passes over the bits of the values.

A double's bits, as a whole number, have the order of the values. Each pass counts the
values by the next 16 of these bits, and only goes on inside the bucket that holds a
wanted rank: four passes at most, of which the driver sees counts of buckets.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 16


def with_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the bits of a double, neither null nor NaN, as a long of the same order; made by exact steps, as Spark has no cast for it."""
    size = F.abs(value)
    near = F.floor(F.log2(F.when((size > 0) & (size < math.inf), size))).cast("long")
    power = lambda x: F.pow(F.lit(2.0), x)
    exact = F.col("__e") + F.when(power(F.col("__e") + 1) <= size, 1).when(power(F.col("__e")) > size, -1).otherwise(0)
    fraction = ((size / power(F.col("__e")) - 1.0) * 2.0**52).cast("long")
    normal = (F.col("__e") + 1023) * (1 << 52) + fraction
    tiny = (size / 2.0**-1074).cast("long")
    bits = F.when(size == 0, 0).when(size == math.inf, 2047 << 52).when(size < 2.0**-1022, tiny).otherwise(normal)
    return df.withColumn("__e", near).withColumn("__e", exact).withColumn(name, F.when(F.col(value) < 0, -bits).otherwise(bits)).drop("__e")


def _tally(values: DataFrame, shift: int) -> list[dict]:
    """Number, least and greatest value of each bucket, in order."""
    counted = with_bits(values, "value", "bits").groupBy("of", F.shiftright("bits", shift).alias("bucket"))
    found: pa.Table = counted.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).toArrow()
    return found.sort_by([("of", "ascending"), ("bucket", "ascending")]).to_pylist()


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Interpolated quantiles (fractions 0 to 1) of numeric columns; None for a column without values.

    Null and NaN are no values; infinities are. ``df`` is read once a pass, so that a
    costly one is better stored before.
    """
    names = list(wanted)
    each = F.array(*(F.struct(F.lit(k).alias("of"), F.col(x).cast("double").alias("value")) for k, x in enumerate(names)))
    values = df.select(F.inline(each)).where("value is not null and not isnan(value)")
    shift = 64 - _BITS
    rows = _tally(values, shift)
    total = [sum(r["n"] for r in rows if r["of"] == k) for k in range(len(names))]
    places = {(k, p): (total[k] - 1) * p for k, x in enumerate(names) if total[k] for p in wanted[x]}
    ranks = {(k, r) for (k, _), at in places.items() for r in (math.floor(at), math.ceil(at))}
    found: dict[tuple[int, int], float] = {}
    open_ = [(k, r, r, -math.inf, math.inf) for k, r in sorted(ranks)]
    while open_:
        left = []
        for k, rank, inside, low, high in open_:
            for row in rows:
                if row["of"] == k and low <= row["low"] and row["high"] <= high:
                    if inside < row["n"]:
                        break
                    inside -= row["n"]
            if row["low"] == row["high"]:
                found[k, rank] = row["low"]
            else:
                left.append((k, rank, inside, row["low"], row["high"]))
        open_, shift = left, shift - _BITS
        if open_:
            within = F.lit(False)
            for k, low, high in {(k, low, high) for k, _, _, low, high in open_}:
                within |= (F.col("of") == k) & F.col("value").between(low, high)
            rows = _tally(values.where(within), shift)
    out: dict[str, list[float | None]] = {}
    for k, x in enumerate(names):
        out[x] = []
        for p in wanted[x]:
            if not total[k]:
                out[x].append(None)
                continue
            at = places[k, p]
            low, high = found[k, math.floor(at)], found[k, math.ceil(at)]
            out[x].append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out
