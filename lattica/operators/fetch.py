"""Pixels around places, by a registry of tiles that is joined before any pixel is read.

A tile of the registry has a box, a state, and the origin of its mosaic (longitude and
latitude of its corner, and the steps of a pixel), which tiles made by older versions lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import box_around

#: What becomes of a request: answered, refused, nothing there, too slow, or failed otherwise.
OK, BAD, NONE, LATE, FAILED = "ok", "bad request", "no coverage", "timed out", "failed"
#: Outcomes that are not the caller's fault, and so give a rate limiter's slot back.
RELEASED = (LATE, FAILED)


def outcomes(points: DataFrame, registry: DataFrame, width_km: float, height_km: float, cell: float = 1.0) -> DataFrame:
    """Points (point, lat, lon) with status, tile, origin, and a box around each: west, south, east, north.

    ``registry`` has tile, west, south, east, north, origin and state (ready, slow, or else
    broken). Points meet the tiles of their own cell of ``cell`` degrees. Of several tiles
    that hold a point the first by name counts. A point without coordinates, or with some
    out of range, is a bad request, and has no box; only an answered one has an origin.
    """
    good = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    bad = points.where(~F.coalesce(good, F.lit(False)) | F.isnan("lat") | F.isnan("lon"))
    asked = points.where(good & ~F.isnan("lat") & ~F.isnan("lon"))
    at = lambda x: F.floor(F.col(x) / cell)
    spread = registry.withColumn("cx", F.explode(F.sequence(at("west"), at("east")))).withColumn("cy", F.explode(F.sequence(at("south"), at("north"))))
    tiles = spread.select("cx", "cy", "tile", "origin", "state", *(F.col(x).alias(f"t_{x}") for x in ("west", "south", "east", "north")))
    inside = (F.col("lon") >= F.col("t_west")) & (F.col("lon") < F.col("t_east")) & (F.col("lat") >= F.col("t_south")) & (F.col("lat") < F.col("t_north"))
    keyed = asked.withColumns({"cx": at("lon"), "cy": at("lat")})
    held = keyed.join(tiles, ["cx", "cy"]).where(inside).groupBy("point").agg(F.min_by(F.struct("tile", "origin", "state"), "tile").alias("t"))
    west, south, east, north = box_around(F.col("lat"), F.col("lon"), width_km, height_km)
    state = F.col("t.state")
    status = F.when(state.isNull(), NONE).when(state == "ready", OK).when(state == "slow", LATE).otherwise(FAILED)
    boxed = asked.join(held, "point", "left").select(
        "point", "lat", "lon", status.alias("status"), "t.tile", F.when(state == "ready", F.col("t.origin")).alias("origin"),
        west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"),
    )
    return boxed.unionByName(bad.select("point", "lat", "lon", F.lit(BAD).alias("status")), allowMissingColumns=True)


def fetched(found: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels (tile, lat, lon and others) of the tile of each answered point that lie in its box: adds point and origin.

    The tiles' names pick the folders of a pixel table that is partitioned by tile.
    """
    asked = found.where(F.col("status") == OK).select("point", "tile", "origin", "west", "south", "east", "north")
    near = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return pixels.join(asked, "tile").where(near).drop("west", "south", "east", "north")
