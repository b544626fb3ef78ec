"""The pixel table and its grid.

A pixel has a row id ``idx``, grid coordinates ``px`` and ``py`` (x fastest), and an
embedding as an array of doubles. Tables on disk are partitioned by viewport and year
and clustered by (py, px), so that a box of pixels prunes files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Width, and the affine transform from pixels to longitude and latitude."""

    width: int
    a: float
    e: float
    c: float
    f: float
    b: float = 0.0
    d: float = 0.0

    def lon(self, px: Column, py: Column) -> Column:
        return F.lit(self.c) + px * self.a + py * self.b

    def lat(self, px: Column, py: Column) -> Column:
        return F.lit(self.f) + px * self.d + py * self.e

    def column(self, lon: Column) -> Column:
        """Grid column of a clicked longitude: cut towards zero."""
        return ((lon - self.c) / self.a).cast("int")

    def row(self, lat: Column) -> Column:
        return ((lat - self.f) / self.e).cast("int")

    def vertex_column(self, lon: Column) -> Column:
        """Grid column of a polygon's vertex: nearest, halves upwards."""
        return F.floor((lon - self.c) / self.a + 0.5).cast("int")

    def vertex_row(self, lat: Column) -> Column:
        return F.floor((lat - self.f) / self.e + 0.5).cast("int")


#: The grid on which the table `embeddings` is laid out.
GRID = Grid(width=25, a=0.01, e=-0.01, c=-1.0, f=52.0)


def pixels(spark: SparkSession, sf_dir: str, grid: Grid = GRID) -> DataFrame:
    """The table `embeddings` as pixels: idx, px, py, emb, label."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(
        F.col("vec_id").alias("idx"),
        (F.col("vec_id") % grid.width).cast("int").alias("px"),
        F.floor(F.col("vec_id") / grid.width).cast("int").alias("py"),
        F.col("embedding").cast("array<double>").alias("emb"),
        "label",
    )


def second_year(first: DataFrame) -> DataFrame:
    """A later year of the same pixels: each one blended towards the next by a weight of 0 to 1.5."""
    n = first.agg(F.max("idx") + 1).first()[0]
    following = first.select(F.pmod(F.col("idx") - 1, F.lit(n)).alias("idx"), F.col("emb").alias("next"))
    weight = (F.col("idx") % 4) * 0.5
    return first.join(following, "idx").select("idx", "px", "py", F.zip_with("emb", "next", lambda x, y: x + weight * (y - x)).alias("emb"))


def tables_to_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
