"""Codebooks of tiles trained from pixels: k-means in each tile, and of what it leaves over."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import l2sq, once
from ..session import scratch, small
from .sample import lowest


def train(tiled: DataFrame, k: int, per_code: int = 256, rounds: int = 20, seed: int = 42) -> DataFrame:
    """Codebook rows (tile, code, vec) of pixels (idx, tile, emb): k-means of each tile.

    A tile is fitted on ``per_code * k`` of its pixels at most, the first ones in the order of a
    hash of idx, so that a task's memory does not follow the size of tiles. A tile of fewer
    distinct vectors than k has a code for each of them.
    """
    each = tiled.select("tile").distinct().withColumn("wanted", F.lit(per_code * k))
    sample = lowest(tiled.select("tile", "idx", "emb"), ["tile"], each, "idx", seed, "at")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        centres = _lloyd(np.stack(rows.sort_values("at")["emb"].to_numpy()), k, rounds)
        return pd.DataFrame({"tile": key[0], "code": np.arange(len(centres), dtype=np.int32), "vec": list(centres)})

    kind = tiled.schema["tile"].dataType.simpleString()
    return sample.groupBy("tile").applyInPandas(fit, f"tile {kind}, code int, vec array<double>")


def _lloyd(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres that start from the first k distinct rows; one that loses all its rows stays where it was."""
    order = np.sort(np.unique(x, axis=0, return_index=True)[1])[:k]
    centres = x[order].astype(float)
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def encode(tiled: DataFrame, book: DataFrame, code: str = "code") -> DataFrame:
    """Nearest code of each pixel in its tile's codebook, the lower one of equals: adds ``code``, vec and d2."""
    packed = book.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("code", "vec"))).alias("book"))  # k rows a tile
    near = F.array_min(F.transform("book", lambda b: F.struct(l2sq(F.col("emb"), b["vec"]).alias("d2"), b["code"].alias("code"), b["vec"].alias("vec"))))
    found = tiled.join(small(packed, 64), "tile").select(*tiled.columns, once(near).alias("near"))
    return found.select(*tiled.columns, F.col("near.code").alias(code), "near.vec", "near.d2")


def train_stages(tiled: DataFrame, config: dict) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Codes (idx, tile, i1, i2), and codebooks of one or two stages, by the settings of codebook_config().

    For cosine, vectors are brought to length 1 and there is one stage. Codebooks are kept as
    tables, since each is read again to encode.
    """
    spark = tiled.sparkSession
    kept = tiled
    if str(config["metric"]).lower() == "cosine":
        length = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda s, v: s + v * v))
        kept = tiled.withColumn("length", length).withColumn("emb", F.when(F.col("length") > 0, F.transform("emb", lambda v: v / F.col("length"))).otherwise(F.col("emb"))).drop("length")

    def stored(book: DataFrame) -> DataFrame:
        path = scratch(spark, "codebook")
        book.write.parquet(path)
        return spark.read.parquet(path)

    first = stored(train(kept, config["k"]))
    coded = encode(kept, first, "i1")
    if config["k2"] is None:
        return coded.select("idx", "tile", "i1", F.lit(None).cast("int").alias("i2")), first, None
    rest = coded.select("idx", "tile", "i1", F.zip_with("emb", "vec", lambda a, b: a - b).alias("emb"))
    second = stored(train(rest, config["k2"]))
    return encode(rest, second, "i2").select("idx", "tile", "i1", "i2"), first, second
