"""Importance resampling towards a target distribution of hashed word features.

Higher-order functions make each document's array of buckets. What the two collections
hold of each bucket is counted with partial sums in every task, so that only counts are
shuffled. A document's weight is then an aggregate over its array, looking each bucket
up in one literal array of gains.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: Upper and lower case of the only letters that are folded, and the characters of a word before that.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Words of a text, A to Z in lower case; none for null."""
    found = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    # lower() is many times faster than translate(), and the same for words of ASCII
    return F.transform(found, lambda x: F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))


def features(found: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, joined by a space."""

    def of_length(k: int) -> Column:
        starts = F.when(F.size(found) >= k, F.sequence(F.lit(1), F.size(found) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, k), " "))

    longer = [of_length(k) for k in range(2, longest + 1)]
    return F.concat(found, *longer) if longer else found


def hashed(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """Adds buckets, one entry a feature, and n_words."""
    names = fresh(rows, "words")
    cut = rows.withColumn(names[0], words(F.col("text")))
    arrays = F.transform(features(F.col(names[0]), longest), lambda x: (F.crc32(x) % buckets).cast("int"))
    return cut.withColumns({"n_words": F.size(names[0]), "buckets": arrays}).drop(*names)


def totals(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket: as many numbers as there are buckets."""
    counted = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log ratio of the smoothed shares, rounded down, by bucket."""
    buckets, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return [
        math.floor(1000.0 * math.log(float((int(t) + 1) * (all_s + buckets)) / float((int(s) + 1) * (all_t + buckets))))
        for s, t in zip(source, target, strict=True)
    ]


def importance_resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Weights of all documents and a draw without replacement in their proportion.

    Features are runs of 1 to ``longest`` words, each in the bucket of its CRC-32. The
    gain of a bucket compares its share in the texts of ``target`` with that in all
    documents; a document's weight is the mean of its features' gains, rounded down.
    Gumbel noise drawn from ``seed`` and doc_id is added, and of the documents of
    ``least_words`` words or more ``percent`` in a hundred, those of the highest scores,
    get a rank from 1 on.

    Returns doc_id, n_features, weight, score, rank, one row per input row. A null or
    empty text has no features and weight 0. A null doc_id draws by the empty string and
    comes after all others among equal scores. Rows alike in score and doc_id are ranked
    by a hash of the text, alike rows in any order. Other columns are not looked at; an
    empty table gives an empty result.
    """
    key = F.col("doc_id").cast("long")
    read = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    rows = stored(hashed(read, buckets, longest).drop("text"))  # texts are cut once; counts and scores read the arrays
    gain = gains(totals(rows, buckets), totals(hashed(target.select(F.col("text").cast("string").alias("text")), buckets, longest), buckets))
    # one folded literal: as a call of array() the plan would have an expression for each entry
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))
    n = F.size("buckets").cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    summed = rows.select("doc_id", n.alias("n_features"), total.alias("total"), noise.alias("noise"), (F.col("n_words") >= least_words).alias("enough"), "tie")
    floored = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    weighed = summed.withColumn("weight", floored)
    scored = stored(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), "enough", "tie", F.monotonically_increasing_id().alias("row")))
    return ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Adds rank to the highest scores of rows that are ``enough``; others have none.

    Scores are whole thousandths between the extrema of gains and noise, so that their
    histogram is bounded by their range; it gives the lowest score that is drawn. Rows from
    there on are sorted over all tasks, and numbered by their task's rows before them.
    """
    found = scored.where("enough").groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("score", "descending")])
    counts = found["n"].to_numpy()
    drawn = int(counts.sum()) * percent // 100
    if drawn == 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    lowest = int(found["score"][int(np.searchsorted(np.cumsum(counts), drawn))].as_py())
    high = F.col("enough") & (F.col("score") >= lowest)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("row"))
    dealt = scored.where(high).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()))
    task, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    per_task = placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("task")  # a row a task
    ends = np.cumsum(per_task["n"].to_numpy())
    before = [(int(t), int(e - n)) for t, e, n in zip(per_task["task"].to_numpy(), ends, per_task["n"].to_numpy(), strict=True)]
    starts = scored.sparkSession.createDataFrame(before, "task long, before long")
    place = F.col("before") + inside + 1
    numbered = placed.withColumn("task", task).join(F.broadcast(starts), "task").withColumn("rank", F.when(place <= drawn, place))
    return numbered.select(*scored.columns, "rank").unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))
