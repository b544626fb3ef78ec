"""Clusters, samples and projections of pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import l2sq, mean_vector, once
from ..session import small
from .search import nearest_rows, packed_blocks


def hash_sample(pixels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of idx, the same ones each time; all if there are fewer."""
    return pixels.orderBy(F.xxhash64("idx", F.lit(seed)), "idx").limit(n)


def stride_sample(pixels: DataFrame, most: int) -> DataFrame:
    """Rows 0, s, 2 s ... of the smallest step s that leaves ``most`` at most."""
    n = pixels.count()
    stride = max(1, -(-n // most))
    return pixels.where((F.col("idx") % stride == 0) & (F.col("idx") < (n // stride) * stride))


def kmeans(pixels: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Clusters of all pixels by centroids fitted on a sample of max(5000, 500 k): assignments, centroids."""
    spark = pixels.sparkSession
    vectors = pixels.withColumn("features", array_to_vector("emb"))
    sample = hash_sample(vectors, max(5_000, 500 * k), seed)
    model = KMeans(k=k, maxIter=20, seed=seed, featuresCol="features", predictionCol="cluster").fit(sample)
    centres = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    return model.transform(vectors).drop("features"), centres


def assign(pixels: DataFrame, centres: DataFrame) -> DataFrame:
    """Cluster of the nearest centroid, the lower number of equal ones: adds cluster and d2."""
    blocks, n = packed_blocks(centres.select("cluster", F.col("centroid").alias("emb")), ("emb", "cluster"))
    near = F.array_min(F.transform("queries", lambda q: F.struct(l2sq(F.col("emb"), q["emb"]).alias("d2"), q["cluster"].alias("cluster"))))
    if n == 1:
        return pixels.crossJoin(blocks).select(*pixels.columns, once(near).alias("best")).select(*pixels.columns, "best.cluster", "best.d2")
    each = pixels.select("idx", "emb").crossJoin(blocks).select("idx", near.alias("best"))
    best = each.groupBy("idx").agg(F.min("best").alias("best"))
    return pixels.join(best.select("idx", "best.cluster", "best.d2"), "idx")


def shares(sizes: DataFrame) -> DataFrame:
    """Sizes (n, one row per cluster) with their share in percent, one decimal."""
    total = F.sum("n").over(Window.partitionBy())
    return sizes.withColumn("pct", F.round(F.col("n") / total * 100, 1))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return shares(assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))


def medoids(assigned: DataFrame) -> DataFrame:
    """Nearest pixel to each centroid, and the radius: the largest distance to the centroid."""
    return assigned.groupBy("cluster").agg(F.min_by("idx", F.struct("d2", "idx")).alias("medoid"), F.sqrt(F.max("d2")).alias("radius"), F.count(F.lit(1)).alias("n"))


def cluster_labels(assigned: DataFrame) -> DataFrame:
    """Clusters as labels: the medoid's embedding, and the largest distance to it as threshold."""
    centre = medoids(assigned).select("cluster", F.col("medoid").alias("idx"))
    seeds = assigned.select("idx", F.col("emb").alias("embedding")).join(small(centre), "idx").select("cluster", F.col("idx").alias("medoid"), "embedding")
    far = assigned.join(small(seeds), "cluster").groupBy("cluster", "medoid").agg(F.sqrt(F.max(l2sq("emb", "embedding"))).alias("threshold"), F.count(F.lit(1)).alias("pixel_count"))
    return far


def centred(pixels: DataFrame) -> DataFrame:
    """Vectors without their mean."""
    mean = mean_vector(pixels).select(F.col("emb").alias("mean"))
    return pixels.crossJoin(F.broadcast(mean)).withColumn("emb", F.zip_with("emb", "mean", lambda x, m: x - m)).drop("mean")


def principal_components(pixels: DataFrame, k: int = 3, most: int = 40_000) -> tuple[DataFrame, list[list[float]], list[float]]:
    """The first k principal components of centred vectors, fitted on a strided sample.

    Signs are such that each component's largest entry is positive. Returns scores
    (idx, pc), components, and shares of variance.
    """
    held = centred(pixels)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(stride_sample(held, most).withColumn("features", array_to_vector("emb")))
    loadings = model.pc.toArray().T
    loadings = [(v * (1 if v[abs(v).argmax()] >= 0 else -1)).tolist() for v in loadings]
    dot = lambda w: F.aggregate(F.zip_with("emb", F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return held.select("idx", F.array(*map(dot, loadings)).alias("pc")), loadings, model.explainedVariance.toArray().tolist()


def knn_graph(pixels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest other pixels of each query (idx, emb), by rank: the graph that layouts start from."""
    near = nearest_rows(pixels, queries, k + 1).where("source <> idx")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("d2", "idx"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("source", "idx", "d2", "rank")


def fuzzy_weights(graph: DataFrame, steps: int = 64) -> DataFrame:
    """Weights of the edges of a neighbour graph (source, idx, d2, k edges a source): source, idx, weight.

    An edge's weight falls off with its length beyond the source's shortest one, at a rate
    that is found by bisection: the weights of a source's edges sum to the logarithm of
    their number to base two.
    """
    length = F.sqrt("d2")
    held = graph.groupBy("source").agg(F.collect_list(F.struct("idx", length.alias("d"))).alias("edges"))  # k edges
    nearest = F.array_min(F.filter(F.transform("edges", lambda e: e["d"]), lambda d: d > 0))
    known = held.withColumns({"near": F.coalesce(nearest, F.lit(0.0)), "goal": F.log2(F.size("edges").cast("double"))})
    weight = lambda d, rate: F.when(d <= F.col("near"), 1.0).otherwise(F.exp((F.col("near") - d) / rate))
    summed = lambda rate: F.aggregate("edges", F.lit(0.0), lambda s, e: s + weight(e["d"], rate))
    none = F.lit(float("inf"))
    state = lambda low, high, rate: F.struct(low.alias("low"), high.alias("high"), rate.alias("rate"))

    def halve(s: Column, _: Column) -> Column:
        above = summed(s["rate"]) > F.col("goal")
        up = F.when(s["high"] == none, s["rate"] * 2).otherwise((s["rate"] + s["high"]) / 2)
        return F.when(above, state(s["low"], s["rate"], (s["low"] + s["rate"]) / 2)).otherwise(state(s["rate"], s["high"], up))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(F.lit(0.0), none, F.lit(1.0)), halve)["rate"]
    rated = known.withColumn("rate", F.greatest(found, F.lit(1e-12)))
    return rated.select("source", F.inline(F.transform("edges", lambda e: F.struct(e["idx"].alias("idx"), weight(e["d"], F.col("rate")).alias("weight")))))


def fuzzy_union(weights: DataFrame) -> DataFrame:
    """Undirected edges a < b: the weights of both directions as a probability that one of them holds."""
    ends = weights.select(F.least("source", "idx").alias("a"), F.greatest("source", "idx").alias("b"), "weight").where("a <> b")
    both = ends.groupBy("a", "b").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("m"))
    return both.select("a", "b", F.when(F.col("n") > 1, F.col("s") - F.col("m") * (F.col("s") - F.col("m"))).otherwise(F.col("s")).alias("weight"))


def neighbourhood(pixels: DataFrame, reach: int = 1, tile: int = 32) -> DataFrame:
    """Vectors of the (2 reach + 1)^2 pixels around each, row by row, end to end; gaps beyond the edge repeat the centre.

    Each vector goes to its tile, and to those next to it if it lies in their margin: a group
    has (tile + 2 reach)^2 pixels at most.
    """
    tiles = lambda p: F.sequence(F.floor((F.col(p) - reach) / tile), F.floor((F.col(p) + reach) / tile))
    held = pixels.select("idx", "px", "py", "emb", F.explode(tiles("px")).alias("tx")).withColumn("ty", F.explode(tiles("py")))
    steps = range(-reach, reach + 1)

    def around(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["px"].to_numpy() - key[0] * tile
        y = rows["py"].to_numpy() - key[1] * tile
        vectors = np.stack(rows["emb"].to_numpy())
        at = np.full((tile + 2 * reach, tile + 2 * reach), -1)
        at[y + reach, x + reach] = np.arange(len(rows))
        own = np.flatnonzero((x >= 0) & (x < tile) & (y >= 0) & (y < tile))
        near = [at[y[own] + reach + dy, x[own] + reach + dx] for dy in steps for dx in steps]
        found = [vectors[np.where(n < 0, own, n)] for n in near]
        return pd.DataFrame({"idx": rows["idx"].to_numpy()[own], "features": pd.Series(list(np.concatenate(found, axis=1)), dtype=object)})

    return held.groupBy("tx", "ty").applyInPandas(around, f"idx {pixels.schema['idx'].dataType.simpleString()}, features array<double>")
