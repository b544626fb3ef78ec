"""Tables of pixels, codebooks and metadata, and the options that choose among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import dequantise
from ..operators.quant import quantise_pixels, reconstruct

#: The codebook settings of a source without any, and of a viewport's file that leaves some out.
SOURCE_DEFAULTS = {"tile": 512, "k": 20, "k2": 256, "metric": "L2"}
VIEWPORT_DEFAULTS = {"tile": 64, "k": 256, "k2": None, "metric": "L2"}


def codebook_config(given: dict | None, defaults: dict = SOURCE_DEFAULTS) -> dict:
    """Settings of vector quantisation: whole positive sizes, and no second stage for cosine."""
    out = defaults | {k: v for k, v in (given or {}).items() if k in defaults and v is not None}
    for key in ("tile", "k", "k2"):
        if out[key] is not None:
            out[key] = int(out[key])
            if out[key] <= 0:
                raise ValueError(f"{key} must be a positive whole number")
    if str(out["metric"]).lower() == "cosine":
        out["k2"] = None
    return out


def read_pixels(spark: SparkSession, path: str, viewport: str, years: list[int] | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels of a viewport; years prune folders, and a box (x0, y0, x1, y1, ends exclusive) prunes row groups."""
    found = spark.read.parquet(path).where(F.col("viewport_id") == viewport)
    if years is not None:
        found = found.where(F.col("year").isin(years))
    if box is not None:
        x0, y0, x1, y1 = box
        found = found.where((F.col("px") >= x0) & (F.col("px") < x1) & (F.col("py") >= y0) & (F.col("py") < y1))
    return found


def read_codebooks(spark: SparkSession, folder: str, viewport: str, year: int) -> tuple[DataFrame, DataFrame]:
    """Decoded codebook (tile, code, vec) and pixel codes of a viewport's year, from the tables of a quantised structure."""
    mine = lambda name: spark.read.parquet(f"{folder}/{name}").where((F.col("viewport_id") == viewport) & (F.col("year") == year)).drop("viewport_id", "year")
    book = mine("codebook").join(mine("codebook_scale"), "tile")
    return book.select("tile", "code", dequantise("q", "low", "high").alias("vec")), mine("pixel_code")


def read_vectors(spark: SparkSession, folder: str, viewport: str, year: int) -> DataFrame:
    """Codes 0..255 of a viewport's year (idx, px, py, q, low, high), from the first of these tables that holds it.

    codebook, codebook_scale and pixel_code (decoded, then quantised again to the nearest code);
    pixel_byte and pixel_byte_scale (codes as stored); pixel (vectors, codes cut). A year that is
    nowhere, or all of whose values are zero, raises ValueError.
    """
    mine = lambda name: read_pixels(spark, f"{folder}/{name}", viewport, [year]).drop("viewport_id", "year")

    def holds(name: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) and not mine(name).isEmpty()

    if holds("pixel_code"):
        book, codes = read_codebooks(spark, folder, viewport, year)
        found = quantise_pixels(reconstruct(codes, book).withColumnRenamed("vec", "emb"), nearest=True)
    elif holds("pixel_byte"):
        found = mine("pixel_byte").crossJoin(F.broadcast(mine("pixel_byte_scale")))
    elif holds("pixel"):
        found = quantise_pixels(mine("pixel"))
    else:
        raise ValueError(f"no vectors of {viewport} in {year}")
    out = found.select("idx", "px", "py", "q", "low", "high")
    if out.where(F.exists("low", lambda x: x != 0) | F.exists("high", lambda x: x != 0)).isEmpty():
        raise ValueError(f"all vectors of {viewport} in {year} are zero")
    return out


def missing_years(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Requested (viewport_id, year) that no table holds yet."""
    return requested.join(done.select("viewport_id", "year").distinct(), ["viewport_id", "year"], "left_anti")


def same_bounds(mosaics: DataFrame, west: float, south: float, east: float, north: float, within: float = 1e-4) -> DataFrame:
    """Mosaics whose four bounds each lie closer than ``within`` degrees."""
    near = F.lit(True)
    for name, value in (("west", west), ("south", south), ("east", east), ("north", north)):
        near = near & (F.abs(F.col(name) - value) < within)
    return mosaics.where(near)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved evaluation results or configurations, one JSON document per file."""
    return spark.read.json(path, multiLine=True)
