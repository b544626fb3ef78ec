"""Scalar quantisation, and vector quantisation with codebooks of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import bounds, dequantise, quantise
from ..session import small


def quantise_pixels(pixels: DataFrame, nearest: bool = False) -> DataFrame:
    """Codes of every pixel by the bounds of the whole table: adds q, low and high."""
    return pixels.crossJoin(F.broadcast(bounds(pixels))).withColumn("q", quantise("emb", "low", "high", nearest))


def decoded(quantised: DataFrame) -> DataFrame:
    return quantised.withColumn("decoded", dequantise("q", "low", "high"))


def check_vectors(pixels: DataFrame) -> DataFrame:
    """Whether all vectors are zero, and whether all are NaN, in one row."""
    return pixels.agg(
        (~F.max(F.exists("emb", lambda x: x != 0))).alias("all_zero"), F.min(F.forall("emb", F.isnan)).alias("all_nan"), F.count(F.lit(1)).alias("n")
    )


def tiles_along(full: int, tile: int) -> int:
    return -(-full // tile)


def tile_of(p: Column, full: int, tile: int) -> Column:
    """Tile of a pixel along one side; the last tile is pulled back to end at the edge."""
    return F.when(p >= full - tile, tiles_along(full, tile) - 1).otherwise(F.floor(p / tile)).cast("int")


def quantise_codebook(codebook: DataFrame) -> DataFrame:
    """Codebook rows (tile, code, emb) as codes 0..255 by each tile's own bounds."""
    return codebook.join(bounds(codebook, "tile"), "tile").withColumn("q", quantise("emb", "low", "high")).select("tile", "code", "q", "low", "high")


def reconstruct(codes: DataFrame, first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Vectors of pixels (px, py, tile, i1, i2) from one or two stages of decoded codebooks (tile, code, vec).

    A filter on px and py before the call crops before anything is decoded.
    """
    out = codes.join(small(first.select("tile", F.col("code").alias("i1"), F.col("vec").alias("v1")), 100_000), ["tile", "i1"])
    if second is None:
        return out.withColumn("vec", F.col("v1")).drop("v1")
    out = out.join(small(second.select("tile", F.col("code").alias("i2"), F.col("vec").alias("v2")), 100_000), ["tile", "i2"])
    return out.withColumn("vec", F.zip_with("v1", "v2", lambda a, b: a + b)).drop("v1", "v2")


def projected(codebook: DataFrame, weights: Column) -> DataFrame:
    """Dot product of each codebook vector with weights: k products instead of one per pixel."""
    return codebook.select("tile", "code", F.aggregate(F.zip_with("vec", weights, lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x).alias("score"))


def assemble(tiles: DataFrame, height: int, width: int, tile: int) -> DataFrame:
    """Index plane of tiles (row, col, ord, codes as a row-major array); later tiles overwrite earlier ones."""
    cells = tiles.select("row", "col", "ord", F.posexplode("codes").alias("at", "code"))
    top, left = F.least(F.col("row") * tile, F.lit(height - tile)), F.least(F.col("col") * tile, F.lit(width - tile))
    placed = cells.select((left + F.col("at") % tile).cast("int").alias("px"), (top + F.floor(F.col("at") / tile)).cast("int").alias("py"), "ord", "code")
    return placed.groupBy("px", "py").agg(F.max_by("code", "ord").alias("code"))
