"""Exact quantiles against numpy, and the bits that they descend by."""

import math
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from lattica import queries
from lattica.operators.quantile import quantiles, with_bits

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 / 3, 2.0**-1074 * 12345, 2.0**52 + 1, 0.9999999999999999]


def test_bits_have_the_order_of_the_values(spark):
    r = random.Random(3)
    values = ODD + [s * 2.0**e * m for s in (1, -1) for e in range(-1070, 1020, 7) for m in (1.0, 1.9999999999999998, 1 + r.random())]
    values += [x for x in (struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)) if x == x]
    rows = with_bits(spark.createDataFrame([(x,) for x in values], "value double"), "value", "bits").collect()
    for row in rows:
        (bits,) = struct.unpack("<q", struct.pack("<d", abs(row["value"])))
        assert row["bits"] == (-bits if row["value"] < 0 else bits), row


def test_against_numpy(spark):
    r = np.random.default_rng(5)
    a = np.round(r.normal(size=4001), 2)  # many ties
    b = np.exp(r.normal(size=4001) * 60)  # hundreds of powers of two
    a[::9], b[::7] = 3.0, math.nan
    rows = [(float(x), None if k % 5 == 0 else float(y), 7.0 if k % 2 else math.nan, None) for k, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    at = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]
    found = quantiles(df, {x: at for x in "abcd"})
    kept = np.array([x[1] for x in rows if x[1] is not None and x[1] == x[1]])
    assert found["a"] == [float(np.quantile(a, p)) for p in at] or np.allclose(found["a"], np.quantile(a, at), rtol=1e-15)
    assert np.allclose(found["b"], np.quantile(kept, at), rtol=1e-12)
    assert found["c"] == [7.0] * 6 and found["d"] == [None] * 6
    assert quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}


def test_no_plan_holds_all_values(spark):
    """Neither medians nor cuts are aggregates that keep every value."""
    for name in ("change_stats", "change_bins", "change_colours", "percentile_stretch"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "percentile" not in plan.lower().replace("percentile_stretch", "")


def test_values_of_one_row(spark):
    assert quantiles(spark.range(1).select(F.lit(2.5).alias("x")), {"x": [0.0, 0.5, 1.0]}) == {"x": [2.5, 2.5, 2.5]}
