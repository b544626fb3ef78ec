"""A regressor of the perceptron kind, fitted by gradients that are summed over all rows.

Rows lie in blocks, dealt out and ordered by their id alone. Each round sends the weights
to all tasks; a block's gradient is rounded to a whole number of tiny units, and these are
added, by task and then in a second layer, so that the sum does not depend on how blocks
fall to tasks. The driver holds weights and a few gradients, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import stored

#: Rows of a block, and the units of a gradient that make one.
BLOCK, UNIT = 1024, 2.0**40
_LAYERS = list[tuple[np.ndarray, np.ndarray]]


class Perceptron:
    """Layers of rectified sums, and a last one that is linear; inputs and target are standardised."""

    def __init__(self, sizes: list[int], seed: int = 42):
        self.sizes = sizes
        r = np.random.default_rng(seed)
        parts = [(r.normal(0, math.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
        self.weights = np.concatenate([x.ravel() for pair in parts for x in pair])

    def layers(self, weights: np.ndarray) -> _LAYERS:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        seen, layers = [x], self.layers(weights)
        for k, (w, b) in enumerate(layers):
            z = seen[-1] @ w + b
            seen.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
        return seen

    def gradient(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Half the sum of squared errors, then its gradient."""
        seen = self.forward(x, weights)
        error = seen[-1] - y[:, None]
        parts, delta = [], error
        for k in range(len(self.sizes) - 2, -1, -1):
            parts += [delta.sum(0), (seen[k].T @ delta).ravel()]
            if k:
                delta = (delta @ self.layers(weights)[k][0].T) * (seen[k] > 0)
        return np.concatenate([[0.5 * float((error**2).sum())], *parts[::-1]])


def _blocks(rows: DataFrame, target: str, n: int) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("idx", "emb", F.col(target).cast("double").alias("y"))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("idx"), F.lit(max(1, -(-n // BLOCK)))))
    packed = dealt.groupBy("block").agg(held.alias("r"))
    return packed.select(F.size("r").alias("n"), F.flatten(F.transform("r", lambda r: r["emb"])).alias("x"), F.transform("r", lambda r: r["y"]).alias("y"))


def _summed(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Sum of arrays of whole numbers over all batches, in two layers."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in fn(batch):
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["g"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(x, np.int64) for batch in batches for x in batch.column("g").to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([sum(parts[1:], parts[0]).tolist()], pa.list_(pa.int64()))], names=["g"])

    by_task = df.mapInArrow(first, "g array<bigint>")
    width = int(math.sqrt(df.rdd.getNumPartitions()))
    layered = by_task.repartition(width).mapInArrow(again, "g array<bigint>") if width > 2 else by_task
    found = [np.asarray(x, np.int64) for x in layered.toArrow()["g"].to_pylist()]
    return sum(found[1:], found[0])


def fit(train: DataFrame, target: str, hidden: tuple[int, ...] = (64, 32), rounds: int = 100, penalty: float = 1e-4, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``prediction`` to rows (idx, emb), fitted on rows (idx, emb, target).

    The rounds are those of a quasi-Newton method (limited memory, with a step that is
    halved until the loss falls). Rows without a target or a whole vector are passed over;
    the same rows give the same weights for any partitioning.
    """
    whole = F.col("emb").isNotNull() & F.col(target).isNotNull() & ~F.exists("emb", lambda x: x.isNull() | F.isnan(x))
    rows = train.where(whole & ~F.isnan(F.col(target).cast("double")))
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit")
    held = stored(_blocks(rows, target, n))
    width = len(rows.select("emb").first()["emb"])
    wide = max(1.0, float(n))

    def moments(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for x, y in _arrays(batch):
            both = np.column_stack([x, y])
            yield np.rint(np.concatenate([both.sum(0), (both**2).sum(0)]) / wide * UNIT).astype(np.int64)

    sums = _summed(held, moments) / UNIT
    mean, square = sums[: width + 1], sums[width + 1 :]
    scale = np.sqrt(np.maximum(square - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    net = Perceptron([width, *hidden, 1], seed)

    def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
        shared = held.sparkSession.sparkContext.broadcast(weights)

        def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for x, y in _arrays(batch):
                g = net.gradient((x - mean[:-1]) / scale[:-1], (y - mean[-1]) / scale[-1], shared.value)
                yield np.rint(g / wide * UNIT).astype(np.int64)

        found = _summed(held, run) / UNIT
        shared.destroy()
        return found[0] + penalty / 2 * float(weights @ weights), found[1:] + penalty * weights

    weights = descend(loss, net.weights, rounds)

    def predict(df: DataFrame) -> DataFrame:
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column("emb").to_pylist()
                out = [None if v is None else float(net.forward((np.asarray([v], float) - mean[:-1]) / scale[:-1], weights)[-1][0, 0] * scale[-1] + mean[-1]) for v in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, "prediction"])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("prediction", DoubleType())]))

    predict.weights = weights
    return predict


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(batch.num_rows):
        n = batch.column("n")[k].as_py()
        yield batch.column("x")[k].values.to_numpy(zero_copy_only=False).reshape(n, -1), batch.column("y")[k].values.to_numpy(zero_copy_only=False)


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], weights: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Weights after so many rounds, fewer where the loss no longer falls."""
    value, slope = loss(weights)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, kept = -slope, []
        for s, y in reversed(steps):
            a = s @ way / (y @ s)
            kept.append(a)
            way = way - a * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y) / (y @ y)
        else:
            way = way / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            way = way + (a - y @ way / (y @ s)) * s
        size, fall = 1.0, float(slope @ way)
        while size > 1e-6:
            ahead = weights + size * way
            new, new_slope = loss(ahead)
            if new <= value + 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = ahead - weights, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = value - new < 1e-7 * max(1.0, abs(value))
        weights, value, slope = ahead, new, new_slope
        if done:
            break
    return weights
