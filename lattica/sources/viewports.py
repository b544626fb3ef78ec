"""Viewport descriptions in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lines of a viewport's file, by the column they give.
FIELDS = {
    "center_lat": r"(?m)(?<!Min )(?<!Max )Latitude:\s*([-\d.]+)°",
    "center_lon": r"(?m)(?<!Min )(?<!Max )Longitude:\s*([-\d.]+)°",
    "min_lat": r"Min Latitude:\s*([-\d.]+)°",
    "max_lat": r"Max Latitude:\s*([-\d.]+)°",
    "min_lon": r"Min Longitude:\s*([-\d.]+)°",
    "max_lon": r"Max Longitude:\s*([-\d.]+)°",
}
DEFAULT_SIZE_KM = 10.0


def parse_viewports(documents: DataFrame) -> DataFrame:
    """Viewports of texts ``value``, with ``problem``: what is wrong with one, or null."""
    number = lambda p: F.regexp_extract("value", p, 1).try_cast("double")
    rows = documents.select(
        F.trim(F.regexp_extract("value", r"Viewport ID:\s*(.+)", 1)).alias("viewport_id"),
        *(number(p).alias(k) for k, p in FIELDS.items()),
        F.coalesce(number(r"Size:\s*([\d.]+)km"), F.lit(DEFAULT_SIZE_KM)).alias("size_km"),
    )
    empty = (F.col("viewport_id") == "") | F.greatest(*(F.col(k).isNull().cast("int") for k in FIELDS)).cast("boolean")
    beyond = lambda limit, *names: F.greatest(*(F.abs(F.col(x)) for x in names)) > limit
    problem = (
        F.when(empty, "fields are missing")
        .when(beyond(90, "center_lat", "min_lat", "max_lat"), "a latitude is out of range")
        .when(beyond(180, "center_lon", "min_lon", "max_lon"), "a longitude is out of range")
        .when(F.col("min_lat") >= F.col("max_lat"), "latitudes are not in order")
        .when(F.col("min_lon") >= F.col("max_lon"), "longitudes are not in order")
    )
    return rows.withColumn("problem", problem)


def read_viewports(spark: SparkSession, path: str) -> DataFrame:
    return parse_viewports(spark.read.text(path, wholetext=True))
