"""From a source of pixels to the tables of a viewport, all years in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import bounds, quantise
from ..operators.quant import check_vectors

KEYS = ("viewport_id", "year")


def rebased(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels of a box counted from its corner, with row numbers x fastest; NaN counts as 0."""
    cut = pixels.where((F.col("px") >= x0) & (F.col("px") < x1) & (F.col("py") >= y0) & (F.col("py") < y1))
    moved = cut.withColumns({"px": F.col("px") - x0, "py": F.col("py") - y0, "emb": F.transform("emb", lambda x: F.nanvl(x, F.lit(0.0)))})
    return moved.withColumn("idx", F.col("py").cast("long") * (x1 - x0) + F.col("px"))


def quantised_years(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes of all pixels by the bounds of their viewport and year, and those bounds."""
    by_year = bounds(pixels, *KEYS)  # a row for each viewport and year
    coded = pixels.join(by_year, list(KEYS)).withColumn("q", F.transform(quantise("emb", "low", "high"), lambda x: x.cast("smallint")))
    return coded.drop("emb", "low", "high"), by_year


def failures(pixels: DataFrame) -> DataFrame:
    """Years without any coverage: all values zero, or all missing."""
    found = pixels.groupBy(*KEYS).agg((~F.max(F.exists("emb", lambda x: (x != 0) & ~F.isnan(x)))).alias("empty"))
    return found.where("empty").select(*KEYS, F.lit("no coverage").alias("message"))


__all__ = ["KEYS", "check_vectors", "failures", "quantised_years", "rebased"]
