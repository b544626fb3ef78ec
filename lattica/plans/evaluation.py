"""Evaluation runs: truth joined to pixels, models trained and scored, events and results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cluster, evaluate
from ..operators.geom import rasterise
from ..sinks.tables import class_raster


def labelled_pixels(pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pixels under truth polygons (polygon, vertices, label); of several the last one counts."""
    hits = rasterise(pixels.select("idx", "px", "py"), polygons.select(F.struct("polygon", "label").alias("polygon"), "vertices"))
    won = hits.groupBy("idx").agg(F.max("polygon").alias("p")).select("idx", F.col("p.label").alias("label"))
    return pixels.drop("label").join(won, "idx")


def run_kfold(rows: DataFrame, models: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Scores of each model over all rows, each row predicted by a model of the other folds."""
    out = None
    for name in models:
        scored = evaluate.f1_summary(evaluate.cross_validated(rows, name, k, seed)).withColumn("model", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out


def across_years(train: DataFrame, test: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Predictions for the test places in another year by a model of the training places."""
    t = train.join(split.where("split = 'train'").select("idx"), "idx", "left_semi")
    u = test.join(split.where("split = 'test'").select("idx"), "idx", "left_semi")
    return evaluate.fit_predict(name, t, u)


def curve_points(scores: DataFrame, train_pixels: str, total: int) -> DataFrame:
    """Places on a learning curve in percent of all pixels, with a band of one deviation cut at 0 and 1."""
    return scores.withColumns({
        "x": F.col(train_pixels) / F.lit(float(total)) * 100,
        "low": F.greatest(F.lit(0.0), F.col("mean_f1") - F.col("std_f1")),
        "high": F.least(F.lit(1.0), F.col("mean_f1") + F.col("std_f1")),
    })


def class_map(labelled: DataFrame, pixels: DataFrame, name: str = "nn", **params) -> DataFrame:
    """A raster of classes: a model of all labelled rows (idx, emb, label) over every pixel.

    Classes are numbered from 1 in the order of their labels.
    """
    found = evaluate.fit_predict(name, labelled, pixels.drop("label"), **params)
    seen = labelled.select(F.col("label").alias("class")).where("class is not null").distinct()
    classes = seen.withColumn("class_id", F.row_number().over(Window.partitionBy().orderBy("class")))  # as few as classes
    return class_raster(found, classes)


def synthetic_truth(pixels: DataFrame, classes: int = 16, kind: str = "random", seed: int = 42) -> DataFrame:
    """Pixels with made-up labels, to check scores by: "random" ones tell a model nothing, "clusters" are those of k-means."""
    bare = pixels.drop("label")
    if kind == "random":
        return bare.withColumn("label", F.pmod(F.xxhash64("idx", F.lit(seed)), F.lit(classes)).cast("int"))
    if kind == "clusters":
        return cluster.kmeans(bare, classes, seed)[0].withColumnRenamed("cluster", "label")
    raise ValueError(f"no truth of the kind {kind}")
