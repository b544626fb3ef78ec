"""All levels of an image as one table, and map tiles looked up in it.

An image is a table of pixels (viewport, year, px, py and bands) on the grid of its
viewport. Each of its pixels is dealt to the levels that show it, in one pass; rows lie in
folders by viewport, year and level, and within these in Morton order, so that a tile's
box of pixels is a few row groups of one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import pyramid_level, tile_lat, tile_lon
from ..session import small

#: Fixed value: levels of an image, each half as wide and high as the one before.
LEVELS = 6
#: Folders that a scan names one by one.
FOLDERS = 200


def sizes(images: DataFrame) -> DataFrame:
    """A row for each level of images (viewport, year, width, height, a, c, e, f): its size and its own transform."""
    each = images.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    half = lambda x: F.greatest(F.lit(1), F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("level")))).cast("int")
    made = each.withColumns({"w": half("width"), "h": half("height")})
    return made.select(
        "viewport", "year", "level", F.col("w").alias("width"), F.col("h").alias("height"),
        (F.col("a") * (F.col("width") / F.col("w"))).alias("a"), F.col("c"), (F.col("e") * (F.col("height") / F.col("h"))).alias("e"), F.col("f"),
    )


def _shown(p: Column, full: Column, size: Column) -> Column:
    """The place along a level's side that shows pixel ``p`` of the full side; null for pixels that it leaves out."""
    step = full / size
    near = F.floor(p / step).cast("long")
    shows = lambda at: (at >= 0) & (at < size) & (F.floor((at + 0.5) * step) == p)
    return F.coalesce(*(F.when(shows(near + d), near + d) for d in (0, -1, 1)))


def morton(x: Column, y: Column) -> Column:
    """The bits of two numbers below 2**31, interleaved."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def levels(image: DataFrame, images: DataFrame) -> DataFrame:
    """Every level's pixels: viewport, year, level, col, row and the bands of ``image``, in one pass over it.

    ``images`` has the size and transform of each viewport's year. A level shows the
    pixel nearest to each of its centres.
    """
    width, height = F.col("__w"), F.col("__h")
    known = images.select("viewport", "year", F.col("width").alias("__w"), F.col("height").alias("__h"))
    side = lambda full, k: F.greatest(F.lit(1).cast("long"), F.shiftright(full.cast("long"), k))
    each = F.array(*(F.struct(F.lit(k).alias("level"), _shown(F.col("px"), width, side(width, k)).alias("col"), _shown(F.col("py"), height, side(height, k)).alias("row")) for k in range(LEVELS)))
    dealt = F.filter(each, lambda x: x["col"].isNotNull() & x["row"].isNotNull())
    bands = [x for x in image.columns if x not in ("viewport", "year", "px", "py")]
    return image.join(small(known), ["viewport", "year"]).select("viewport", "year", *bands, F.inline(dealt))


def write_levels(found: DataFrame, path: str) -> None:
    """levels() as a table in folders by viewport, year and level, in Morton order within them."""
    keys = ("viewport", "year", "level")
    keyed = found.withColumn("morton", morton(F.col("col"), F.col("row")))
    keyed.repartitionByRange(*keys, "morton").sortWithinPartitions(*keys, "morton").write.mode("overwrite").partitionBy(*keys).parquet(path)


def windows(requests: DataFrame, levels_of: DataFrame) -> DataFrame:
    """The pixels that each request (viewport, year, z, x, y) shows: level, and x0, y0, w, h on it; none without an image."""
    z = F.col("z")
    boxed = requests.withColumns({
        "level": pyramid_level(z), "west": tile_lon(F.col("x"), z), "east": tile_lon(F.col("x") + 1, z), "north": tile_lat(F.col("y"), z), "south": tile_lat(F.col("y") + 1, z),
    })
    on = boxed.join(small(levels_of.select("viewport", "year", "level", "a", "c", "e", "f")), ["viewport", "year", "level"])
    left, top = (F.col("west") - F.col("c")) / F.col("a"), (F.col("north") - F.col("f")) / F.col("e")
    w, h = F.rint((F.col("east") - F.col("c")) / F.col("a") - left), F.rint((F.col("south") - F.col("f")) / F.col("e") - top)
    return on.select(*requests.columns, "level", F.rint(left).cast("long").alias("x0"), F.rint(top).cast("long").alias("y0"), w.cast("long").alias("w"), h.cast("long").alias("h")).where("w > 0 and h > 0")


def tiles(stored_levels: DataFrame, levels_of: DataFrame, requests: DataFrame, size: int = 256) -> DataFrame:
    """Requested map tiles (viewport, year, z, x, y) as pixels: the request's columns, tile_col, tile_row, and the bands.

    A tile's window is stretched to ``size`` by the nearest pixel. Places outside the
    image have no row, so that a tile without data, or of a viewport or year that is not
    there, is empty. The windows' viewports, years and levels name the folders that are read.
    """
    found = windows(requests.distinct(), levels_of)
    keys = ["viewport", "year", "level"]
    steps = F.sequence(F.lit(0), F.lit(size - 1))

    def side(df: DataFrame, start: str, length: str, place: str) -> DataFrame:
        """The places along a side of each window, each with the first and last step of the tile that shows it."""
        at = lambda step: F.floor((step + 0.5) * F.col(length) / size) + F.col(start)
        turns = F.filter(steps, lambda step: (step == 0) | (at(step) != at(step - 1)))
        each = df.withColumn("__turns", turns).select("*", F.posexplode("__turns").alias("__k", f"{place}_first"))
        last = F.coalesce(F.get("__turns", F.col("__k") + 1) - 1, F.lit(size - 1))
        return each.withColumns({place: at(F.col(f"{place}_first")), f"{place}_last": last}).where(F.col(place) >= 0).drop("__turns", "__k")

    spots = side(side(found, "x0", "w", "col"), "y0", "h", "row").drop("x0", "y0", "w", "h")
    bands = [x for x in stored_levels.columns if x not in (*keys, "col", "row", "morton")]
    folders = found.select(keys).distinct().limit(FOLDERS + 1).collect()
    if len(folders) <= FOLDERS:  # named in the scan; of more, the join picks the rows
        named = F.lit(False)
        for f in folders:
            named |= (F.col("viewport") == f["viewport"]) & (F.col("year") == f["year"]) & (F.col("level") == f["level"])
        stored_levels = stored_levels.where(named)
    hit = stored_levels.join(small(spots, 100_000), [*keys, "col", "row"])  # by both places: as large as the windows
    shown = lambda place: F.explode(F.sequence(f"{place}_first", f"{place}_last"))
    return hit.withColumn("tile_col", shown("col")).withColumn("tile_row", shown("row")).select("viewport", "year", "z", "x", "y", "tile_col", "tile_row", *bands)


def bounds(levels_of: DataFrame) -> DataFrame:
    """Box and centre of each image, by its full level."""
    full = levels_of.where("level = 0")
    east, south = F.col("c") + F.col("a") * F.col("width"), F.col("f") + F.col("e") * F.col("height")
    return full.select(
        "viewport", "year", F.col("c").alias("west"), south.alias("south"), east.alias("east"), F.col("f").alias("north"),
        ((south + F.col("f")) / 2).alias("center_lat"), ((F.col("c") + east) / 2).alias("center_lon"),
    )
