"""Quality classifier on subword embeddings.

A document is the mean of learned vectors of its hashed words and character
n-grams; a softmax over two classes follows. Vectors and output weights are trained
together by stochastic gradient descent in numpy, on a bounded sample. For scoring,
each bucket's vector and the output weights fold into one number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BUCKETS = 1 << 17
DIMENSIONS = 12
_GRAMS = (3, 4)
_EPOCHS = 6
#: Steps of training at least: few examples are gone through more often.
_LEAST_STEPS = 20_000


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words, then of the n-grams inside words, with the number of each one's text."""
    starts, ends = c.runs(~c.SPACE[data], offsets)
    texts = c.owner(c.first_of(starts, offsets)).astype(np.int32)
    hashed = c.Hasher(data)
    mask = np.uint64(BUCKETS - 1)
    yield (hashed(starts, ends) & mask).astype(np.int32), texts
    for n in _GRAMS:
        counts = np.maximum(ends - starts - n + 1, 0)
        which = np.repeat(np.arange(len(starts)), counts)
        at = np.arange(len(which)) + np.repeat(starts - np.cumsum(counts) + counts, counts)
        yield (hashed(at, at + n) & mask).astype(np.int32), texts[which]


def bags(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text, and how often each occurs."""
    found = [np.concatenate(x) for x in zip(*features(data, offsets), strict=True)]
    order = np.argsort(found[1], kind="stable")
    buckets, ends = found[0][order], np.searchsorted(found[1][order], np.arange(len(offsets)))
    return [np.unique(buckets[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Each bucket's share in the log odds of class 1, and their bias."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    epochs = max(_EPOCHS, -(-_LEAST_STEPS // len(examples)))
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            buckets, counts = examples[i]
            now = np.float32(rate * (1 - done / steps))
            done += 1
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            mean = share @ vectors[buckets]
            logits = output @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ output
            output -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            vectors[buckets] -= now * np.outer(share, back)
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, tuple[np.ndarray, np.ndarray]]] = []
    for batch in batches:
        for part, data, offsets in c.chunks(batch, "text"):
            rows += zip(part.column("doc_id").to_pylist(), part.column("quality").to_pylist(), bags(data, offsets), strict=True)
    rows.sort(key=lambda x: (x[0], x[1]))
    if len({x[1] for x in rows}) < 2:
        weights, bias = np.zeros(BUCKETS, np.float32), 20.0 if rows and rows[0][1] else 0.0 if not rows else -20.0
    else:
        weights, bias = train([x[2] for x in rows], np.array([x[1] for x in rows]))
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = np.frombuffer(model.value[0], np.float32).astype(np.float64), model.value[1]
        for batch in batches:
            for part, data, offsets in c.chunks(batch, "text"):
                n = len(offsets) - 1
                total, count = np.zeros(n), np.zeros(n)
                for buckets, texts in features(data, offsets):
                    total += np.bincount(texts, weights[buckets], n)
                    count += np.bincount(texts, minlength=n)
                score = 1 / (1 + np.exp(-(bias + total / np.maximum(count, 1))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = 5_000, threshold: float = 0.3) -> DataFrame:
    """A quality score of every whole text.

    Learns from at most ``sample`` labelled documents, drawn by a hash of doc_id from
    those whose crc32(doc_id as text) mod 5 is not 0; only texts are looked at. Returns
    doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted, one row per
    input row. A null or empty text gets the bias's score; null labels are left out; with
    labels of one class or none all scores are near that class, or a half. Of an id with
    several labels the lower one is learnt, and of its texts the one of the least hash, so
    that scores do not change from run to run. Other columns are not looked at; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    one = known.where(~held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("first")
    found = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(first)
    examples = found.select("doc_id", "first.text", "first.quality").repartition(1)  # `sample` rows at most
    model = c.map_batches(examples, _train, "weights binary, bias double").first()
    shared = docs.sparkSession.sparkContext.broadcast((bytes(model["weights"]), model["bias"]) if model else (bytes(4 * BUCKETS), 0.0))
    scored = c.map_batches(rows, _score(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
