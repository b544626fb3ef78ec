"""Viewports, the years they have, coverage, quotas, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small
from .geom import overlaps

FIRST_YEAR, LAST_YEAR = 2018, 2025


def years_of(levels: DataFrame) -> DataFrame:
    """Years of each viewport that have a finest image level, newest first."""
    return levels.where("level = 0").groupBy("viewport_id").agg(F.sort_array(F.collect_set("year"), asc=False).alias("years"))


def visible_to(viewports: DataFrame, user: str | None, superuser: bool = False) -> DataFrame:
    """Viewports that are not private, or the user's own, or all for a superuser."""
    if superuser:
        return viewports
    own = F.coalesce(F.col("created_by") == F.lit(user), F.lit(False))
    return viewports.where(~F.coalesce("private", F.lit(False)) | own)


def coverage(tiles: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Tiles that meet a box, for every year there may be."""
    hit = tiles.where((F.col("west") < east) & (F.col("east") > west) & (F.col("south") < north) & (F.col("north") > south))
    counted = hit.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    years = tiles.sparkSession.range(FIRST_YEAR, LAST_YEAR + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(counted, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n_tiles"))


def usable_year(covered: DataFrame, wanted: int) -> DataFrame:
    """The wanted year if it has tiles, else the first that has."""
    return covered.where("n_tiles > 0").agg(F.min_by("year", F.struct((F.col("year") != wanted).alias("other"), "year")).alias("year"))


def sizes_mb(files: DataFrame, *keys: str) -> DataFrame:
    """Size of the files (bytes) of each key in MB, to one decimal."""
    return files.groupBy(*keys).agg(F.round(F.sum("bytes") / 1048576, 1).alias("size_mb"))


def within_quota(used_mb: Column, estimate_mb: Column, quota_mb: Column) -> Column:
    return used_mb + estimate_mb <= quota_mb


def readiness(viewports: DataFrame, vectors: DataFrame, levels: DataFrame, requested: list[int] | None = None) -> DataFrame:
    """Whether each viewport has vectors and images of the requested years, and which years."""
    only = lambda df: df if requested is None else df.where(F.col("year").isin(requested))
    v = only(vectors).select("viewport_id").distinct().withColumn("has_vectors", F.lit(True))
    p = only(levels).where("level = 0").groupBy("viewport_id").agg(F.sort_array(F.collect_set("year")).alias("years_available"))
    out = viewports.select("viewport_id").join(v, "viewport_id", "left").join(p, "viewport_id", "left")
    has = F.coalesce("has_vectors", F.lit(False))
    return out.select(
        "viewport_id", has.alias("has_vectors"), has.alias("has_embeddings"), has.alias("has_umap"), F.col("years_available").isNotNull().alias("has_pyramids"),
        F.coalesce("years_available", F.array().cast("array<int>")).alias("years_available"),
    )


def missing(readied: DataFrame, requested: list[int]) -> DataFrame:
    """Requested years that a viewport lacks."""
    return readied.select("viewport_id", F.array_except(F.array(*map(F.lit, requested)), "years_available").alias("missing_years"))


def with_years(configs: DataFrame, more: list[int]) -> DataFrame:
    """Configurations with further years, in order and once each."""
    bad = [y for y in more if not FIRST_YEAR <= y <= LAST_YEAR]
    if bad:
        raise ValueError(f"no data for {bad}")
    return configs.withColumn("years", F.array_sort(F.array_union("years", F.array(*map(F.lit, more)))))


def unshared_tiles(tiles: DataFrame, gone: DataFrame, kept: DataFrame) -> DataFrame:
    """Tiles (tile, box) that removed viewports (box) needed and no kept one needs."""
    a = tiles.alias("t").join(small(gone.select("box")).alias("g"), overlaps("t.box", "g.box"), "left_semi")
    return a.alias("t").join(small(kept.select("box")).alias("k"), overlaps("t.box", "k.box"), "left_anti")


def without(tables: dict[str, DataFrame], viewport: str) -> dict[str, DataFrame]:
    """All tables without a viewport."""
    return {name: df.where(F.col("viewport_id") != viewport) for name, df in tables.items()}


def progress_percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(current / total * 100).cast("int"))).otherwise(0)
