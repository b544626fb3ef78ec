"""The first rows of each group in the order of a hash, without sorting any group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small

_BITS = 16


def _cut(counted: DataFrame, wanted: DataFrame, by: list[str], bucket: str, left: str) -> DataFrame:
    """The bucket of each group in which the wanted number of rows is reached, and how many of it are wanted."""
    total = F.sum("n").over(Window.partitionBy(*by).orderBy(bucket))
    summed = counted.withColumn("total", total).join(small(wanted), by).where((F.col("total") >= F.col(left)) & (F.col("total") - F.col("n") < F.col(left)))
    return summed.select(*by, bucket, (F.col(left) - F.col("total") + F.col("n")).alias(left))


def lowest(rows: DataFrame, by: list[str], wanted: DataFrame, key: str, seed: int = 42, rank: str | None = None) -> DataFrame:
    """Of each group the ``wanted`` rows (columns ``by`` and wanted) that come first by a hash of ``key``, then by ``key``.

    Counts by 16 bits of the hash, and by 16 more of the bucket that holds the last wanted
    row, find where each group is cut; both are sums that tasks make in part. Only rows of
    that last bucket, one in four thousand million, are ranked. A group with fewer rows keeps all; one
    that ``wanted`` does not name, and those of a null name, keep none. ``rank`` names a
    column for each kept row's place in its group.
    """
    names = ("__hash", "__b1", "__b2")
    hashed = rows.withColumn("__hash", F.xxhash64(key, F.lit(seed)))
    dealt = hashed.withColumns({"__b1": F.shiftright("__hash", 64 - _BITS), "__b2": F.shiftright("__hash", 64 - 2 * _BITS).bitwiseAND((1 << _BITS) - 1)})
    asked = wanted.select(*by, F.col("wanted").cast("long").alias("__left")).where("__left > 0")
    counts = lambda df, b: df.groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"))
    first = _cut(counts(dealt, "__b1"), asked, by, "__b1", "__left").withColumnRenamed("__b1", "__c1")
    inside = dealt.join(small(first), by).where("__b1 = __c1")
    second = _cut(counts(inside, "__b2"), first.drop("__c1"), by, "__b2", "__left").withColumnRenamed("__b2", "__c2")
    cuts = small(asked.select(*by).join(first.drop("__left"), by, "left").join(second, by, "left"))
    placed = dealt.join(cuts, by)
    below = F.col("__c1").isNull() | (F.col("__b1") < F.col("__c1")) | ((F.col("__b1") == F.col("__c1")) & (F.col("__b2") < F.col("__c2")))
    last = placed.where((F.col("__b1") == F.col("__c1")) & (F.col("__b2") == F.col("__c2")))
    order = Window.partitionBy(*by).orderBy("__hash", key)
    edge = last.withColumn("__at", F.row_number().over(order)).where("__at <= __left")
    kept = placed.where(below).select(*rows.columns, "__hash").unionByName(edge.select(*rows.columns, "__hash"))
    if rank:
        kept = kept.withColumn(rank, F.row_number().over(order))  # as many rows as are wanted
    return kept.drop(*names)


def hash_order(key: str, seed: int = 42) -> tuple[Column, Column]:
    """The order that lowest() goes by."""
    return F.xxhash64(key, F.lit(seed)), F.col(key)
