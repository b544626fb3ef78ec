"""The perceptron regressor: gradients, partitioning, and a planted table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import evaluate, perceptron

KIND = "idx long, emb array<double>, target double"


def planted(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        v = [r.uniform(-1, 1) for _ in range(4)]
        rows.append((k, v, 3 * abs(v[0]) + 4 * v[1] * v[2] + 10))
    return rows


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(1)
    net = perceptron.Perceptron([3, 5, 4, 1], 3)
    x, y = r.normal(size=(7, 3)), r.normal(size=7)
    g = net.gradient(x, y, net.weights)
    assert abs(g[0] - 0.5 * ((net.forward(x, net.weights)[-1][:, 0] - y) ** 2).sum()) < 1e-12
    for k in range(0, len(net.weights), 5):
        step = np.zeros(len(net.weights))
        step[k] = 1e-6
        slope = (net.gradient(x, y, net.weights + step)[0] - net.gradient(x, y, net.weights - step)[0]) / 2e-6
        assert abs(slope - g[1 + k]) < 1e-5


def test_same_weights_for_any_partitioning_and_better_than_a_line(spark):
    rows = planted(2500, 5)
    odd = [(9000, None, 1.0), (9001, [0.0, 0.0, 0.0, math.nan], 1.0), (9002, [0.0] * 4, None)]
    df = spark.createDataFrame(rows[:2000] + odd, KIND)
    one = perceptron.fit(df.coalesce(1), "target", (16, 8), 6)
    many = perceptron.fit(df.repartition(13), "target", (16, 8), 6)
    assert np.array_equal(one.weights, many.weights)
    test = spark.createDataFrame(rows[2000:], KIND)
    found = evaluate.fit_predict("mlp_reg", df, test, "target", hidden=(16, 8), max_iter=40)
    r2 = evaluate.regression_scores(found).first()["r2"]
    x, y = np.array([v for _, v, _ in rows]), np.array([t for _, _, t in rows])
    a = np.column_stack([x, np.ones(len(x))])
    line = a[2000:] @ np.linalg.lstsq(a[:2000], y[:2000], rcond=None)[0]
    linear = 1 - ((y[2000:] - line) ** 2).sum() / ((y[2000:] - y[2000:].mean()) ** 2).sum()
    assert r2 > 0.85 > linear + 0.5


def test_no_rows_to_fit(spark):
    with pytest.raises(ValueError, match="no rows"):
        perceptron.fit(spark.createDataFrame([], KIND), "target")
    assert one_value(spark) == [5.0, 5.0]


def one_value(spark):
    """A constant target, and inputs without extent."""
    df = spark.createDataFrame([(k, [1.0, 2.0], 5.0) for k in range(2)], KIND)
    return [round(r["prediction"], 6) for r in perceptron.fit(df, "target", (4,), 3)(df).orderBy(F.col("idx")).collect()]
