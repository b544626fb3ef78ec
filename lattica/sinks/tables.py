"""Partitioned tables of pixels and codebooks, shares and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import email_folder
from ..session import small


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Pixels (viewport_id, year, py, px, ...) in folders by viewport and year, replaced one folder at a time.

    Rows are clustered by place, so that a box reads few row groups.
    """
    placed = pixels.repartitionByRange("viewport_id", "year", "py", "px").sortWithinPartitions("viewport_id", "year", "py", "px")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("viewport_id", "year").parquet(path)


def write_codebooks(codebook: DataFrame, scales: DataFrame, codes: DataFrame, folder: str) -> None:
    """A quantised structure as three tables: codebook, codebook_scale, pixel_code."""
    for name, table in (("codebook", codebook), ("codebook_scale", scales), ("pixel_code", codes)):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("viewport_id", "year").parquet(f"{folder}/{name}")


def submissions(shares: DataFrame) -> DataFrame:
    """The last valid share of each (email, viewport): private and public replace each other."""
    valid = shares.withColumn("owner", email_folder(F.col("email"))).where("owner is not null and format in ('public', 'private')")
    fields = [x for x in valid.columns if x not in ("owner", "viewport")]
    return valid.groupBy("owner", "viewport").agg(F.max_by(F.struct(*fields), "submitted").alias("s")).select("owner", "viewport", "s.*")


def write_shares(shares: DataFrame, path: str) -> None:
    submissions(shares).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner", "viewport").json(path)


def public_shares(shares: DataFrame) -> DataFrame:
    return submissions(shares).where("format = 'public'").select("owner", "viewport", "submitted").orderBy("owner", "viewport")


def private_rows(manual: DataFrame, saved: DataFrame) -> DataFrame:
    """Labels without places: a row for each embedding of a manual label, and for each saved one."""
    every = F.filter(F.concat(F.array("embedding"), F.coalesce("embeddings", F.array().cast("array<array<double>>"))), lambda x: x.isNotNull())
    own = manual.select("name", F.nullif("code", F.lit("")).alias("code"), F.explode(every).alias("embedding"), "type")
    kept = saved.where("embedding is not null").select("name", F.lit(None).cast("string").alias("code"), "embedding", F.lit("similarity").alias("type"))
    return own.unionByName(kept)


def without_places(saved: DataFrame) -> DataFrame:
    return saved.drop("source_pixel")


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines, one folder for each field, year and task."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("field", "year", "task").json(path)


def class_raster(predicted: DataFrame, classes: DataFrame) -> DataFrame:
    """Class ids 1..n of pixels by the order of class names; 0 where nothing is predicted."""
    return predicted.join(small(classes.select(F.col("class").alias("prediction"), "class_id")), "prediction", "left").select("px", "py", F.coalesce("class_id", F.lit(0)).alias("class_id"))
