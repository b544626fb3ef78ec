"""Image levels and windows of pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Grid
from ..session import small, stored
from .quantile import quantiles


def stretched(pixels: DataFrame, dimensions: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Bands of the first dimensions, cut at the 2nd and 98th percentile, as 0..255."""
    bands = stored(pixels.select("idx", "px", "py", *(F.col("emb")[d].alias(f"v{d}") for d in dimensions)))
    cuts = quantiles(bands, {f"v{d}": [0.02, 0.98] for d in dimensions})

    def band(d: int) -> Column:
        low, high = cuts[f"v{d}"]
        v = F.greatest(F.lit(low), F.least(F.lit(high), F.col(f"v{d}")))
        if low is None or high <= low:
            return F.lit(0).alias(f"band{d}")
        return F.when(~F.isnan(f"v{d}"), F.floor((v - low) / (high - low) * 255)).otherwise(0).cast("int").alias(f"band{d}")

    return bands.select("idx", "px", "py", *(band(d) for d in dimensions))


def level(image: DataFrame, width: int, height: int, k: int) -> DataFrame:
    """An image at 1/2^k of its size by the pixel nearest to each new centre."""
    w, h = max(1, width >> k), max(1, height >> k)
    spark = image.sparkSession
    xs = spark.range(w).select(F.col("id").cast("int").alias("col"), F.floor((F.col("id") + 0.5) * (width / w)).cast("int").alias("px"))
    ys = spark.range(h).select(F.col("id").cast("int").alias("row"), F.floor((F.col("id") + 0.5) * (height / h)).cast("int").alias("py"))
    return image.join(F.broadcast(xs), "px").join(F.broadcast(ys), "py")


def enlarged(image: DataFrame, factor: int) -> DataFrame:
    """Each pixel repeated ``factor`` times along both sides."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    return (
        image.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
        .withColumn("px", F.col("px") * factor + F.col("dx")).withColumn("py", F.col("py") * factor + F.col("dy")).drop("dx", "dy")
    )


def window(image: DataFrame, grid: Grid, west: float, south: float, east: float, north: float, size: int = 256) -> DataFrame:
    """The part of an image in a box, stretched to size x size by the nearest pixel; gaps are absent."""
    left, top = (west - grid.c) / grid.a, (north - grid.f) / grid.e
    x0, y0 = round(left), round(top)
    w, h = round((east - grid.c) / grid.a - left), round((south - grid.f) / grid.e - top)
    if w <= 0 or h <= 0:
        return image.limit(0).withColumns({"col": F.lit(0), "row": F.lit(0)})
    spark = image.sparkSession
    side = lambda n, at, p, name: spark.range(size).select(F.col("id").cast("int").alias(name), (F.floor((F.col("id") + 0.5) * n / size) + at).cast("int").alias(p))
    return image.join(F.broadcast(side(w, x0, "px", "col")), "px").join(F.broadcast(side(h, y0, "py", "row")), "py")


def crop(pixels: DataFrame, grid: Grid, west: float, south: float, east: float, north: float, height: int) -> DataFrame:
    """Pixels of a box, floor of its start to ceiling of its end, counted from its corner."""
    x0, x1 = max(0, math.floor((west - grid.c) / grid.a)), min(grid.width, math.ceil((east - grid.c) / grid.a))
    y0, y1 = max(0, math.floor((north - grid.f) / grid.e)), min(height, math.ceil((south - grid.f) / grid.e))
    cut = pixels.where((F.col("px") >= x0) & (F.col("px") < x1) & (F.col("py") >= y0) & (F.col("py") < y1))
    return cut.withColumns({"px": F.col("px") - x0, "py": F.col("py") - y0})


def overlay(pixels: DataFrame, classes: DataFrame, colours: DataFrame) -> DataFrame:
    """Colours of assigned pixels (idx, class) over their box."""
    return pixels.join(classes, "idx").join(small(colours), "class").select("px", "py", "class", "colour")


def pixel_bounds(places: DataFrame, grid: Grid) -> DataFrame:
    """A box of one pixel around each place (lat, lon)."""
    x, y = abs(grid.a) / 2, abs(grid.e) / 2
    return places.withColumns({"west": F.col("lon") - x, "south": F.col("lat") - y, "east": F.col("lon") + x, "north": F.col("lat") + y})
