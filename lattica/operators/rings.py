"""Closed outlines of sets of pixels, by ranking linked lists.

Every side between a pixel of the set and one outside is directed, with the set on its
right. Sides in line are joined to one, and each leads to the one that begins where it
ends. Pointer doubling finds each ring's least side and every side's distance from it in
as many rounds as the longest ring's length has bits, whatever the number of rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Directions of sides: along a row, down, back along a row, up.
EAST, SOUTH, WEST, NORTH = range(4)


def _islands(cells: DataFrame, keys: list[str], along: str) -> DataFrame:
    """Runs of whole numbers: ``keys``, first, last."""
    island = F.col(along) - F.row_number().over(Window.partitionBy(*keys).orderBy(along))
    grouped = cells.withColumn("island", island).groupBy(*keys, "island")
    return grouped.agg(F.min(along).alias("first"), F.max(along).alias("last")).drop("island")


def segments(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Longest straight sides (key, dir, from and to x and y, id) of pixels (key, x, y), and the runs of pixels in rows."""
    rows, columns = _islands(cells, ["key", "y"], "x"), _islands(cells, ["key", "x"], "y")

    def line(direction: int, at: Column, place: str) -> Column:
        return F.struct(F.lit(direction).alias("dir"), at.cast("long").alias("line"), F.col(place).cast("long").alias("at"))

    upright = rows.select("key", F.inline(F.array(line(NORTH, F.col("first"), "y"), line(SOUTH, F.col("last") + 1, "y"))))
    level = columns.select("key", F.inline(F.array(line(EAST, F.col("first"), "x"), line(WEST, F.col("last") + 1, "x"))))
    joined = _islands(upright.unionByName(level), ["key", "dir", "line"], "at")
    low, high = F.col("first"), F.col("last") + 1
    start, end = F.when(F.col("dir").isin(EAST, SOUTH), low).otherwise(high), F.when(F.col("dir").isin(EAST, SOUTH), high).otherwise(low)
    flat = F.col("dir").isin(EAST, WEST)
    pick = lambda yes, no: F.when(flat, yes).otherwise(no)
    made = joined.select(
        "key", "dir", pick(start, F.col("line")).alias("x1"), pick(F.col("line"), start).alias("y1"), pick(end, F.col("line")).alias("x2"), pick(F.col("line"), end).alias("y2")
    )
    return stored(made.withColumn("id", F.monotonically_increasing_id())), rows


def _following(sides: DataFrame) -> DataFrame:
    """id and the id of the side that goes on from its end: where two begin, the one around the same pixel."""
    begins = sides.groupBy("key", F.col("x1").alias("x2"), F.col("y1").alias("y2")).agg(*(F.max(F.when(F.col("dir") == d, F.col("id"))).alias(f"to{d}") for d in range(4)))
    turn = lambda by: F.array(*(F.col(f"to{(d + by) % 4}") for d in range(4)))[F.col("dir")]
    return sides.join(begins, ["key", "x2", "y2"]).select("id", F.coalesce(turn(1), turn(3)).alias("to"))


def _ranked(following: DataFrame) -> DataFrame:
    """id, the least id of its ring, and the number of steps to that one."""
    state, length = stored(following.select("id", "to", F.col("id").alias("least"), F.lit(0).cast("long").alias("steps"))), 1
    while True:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("least").alias("least2"), F.col("steps").alias("steps2"))
        less = F.col("least2") < F.col("least")
        state = stored(
            state.join(ahead, "to").select(
                "id", F.col("next").alias("to"), F.least("least", "least2").alias("least"), F.when(less, F.col("steps2") + length).otherwise(F.col("steps")).alias("steps"), less.alias("less")
            )
        )
        length *= 2
        # if no stretch's least is changed by the stretch behind it, every stretch has seen the whole ring
        if not state.where("less").limit(1).count():
            return state.select("id", "least", "steps")


def outlines(cells: DataFrame, key: str = "label") -> DataFrame:
    """Rings around the pixels (px, py) of each key, corners only: key, polygon, ring, hole, place, x, y.

    Pixels that touch at a corner only are apart. A ring has the set on its right hand
    as y grows downwards, so that outer rings have a positive area and holes a negative
    one; ``place`` counts a ring's corners from 0, and ``polygon`` is the ring that
    surrounds a hole, or the ring itself. Repeated pixels count once; a null key is a key
    like others, and pixels with a null place are left out.
    """
    found = cells.select(F.struct(F.col(key).alias("k")).alias("key"), F.col("px").cast("long").alias("x"), F.col("py").cast("long").alias("y"))
    sides, rows = segments(found.where("x is not null and y is not null").distinct())
    ranked = stored(sides.join(_ranked(_following(sides)), "id"))
    doubled = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    upright = F.col("dir") == SOUTH
    each = ranked.groupBy(F.col("least").alias("ring")).agg(
        F.count(F.lit(1)).alias("corners"), doubled.alias("doubled"), F.first("key").alias("key"), F.min(F.when(upright, F.struct("x1", "y1"))).alias("left")
    )
    rings = stored(each.withColumn("hole", F.col("doubled") < 0))
    # the run of pixels that ends at a hole's leftmost side begins at a side of the ring around it, or of a hole farther left
    before = rings.where("hole").join(rows.select("key", F.col("y").alias("row"), F.col("first"), (F.col("last") + 1).alias("end")), "key")
    before = before.where((F.col("row") == F.col("left.y1")) & (F.col("end") == F.col("left.x1"))).select("ring", "key", F.col("first").alias("x1"), "row")
    walls = ranked.where(F.col("dir") == NORTH).select("key", "x1", F.col("y2").alias("top"), F.col("y1").alias("bottom"), F.col("least").alias("around"))
    owned = stored(before.join(walls, ["key", "x1"]).where("top <= row and row < bottom").select("ring", "around"))
    while True:
        farther = owned.select(F.col("ring").alias("around"), F.col("around").alias("beyond"))
        moved = owned.join(farther, "around", "left")
        if not moved.where("beyond is not null").limit(1).count():
            break
        owned = stored(moved.select("ring", F.coalesce("beyond", "around").alias("around")))
    named = rings.join(owned, "ring", "left").select("ring", "hole", "corners", F.coalesce("around", "ring").alias("polygon"))
    place = (F.col("corners") - F.col("steps")) % F.col("corners")
    out = ranked.withColumnRenamed("least", "ring").join(named, "ring")
    return out.select(F.col("key.k").alias(key), "polygon", "ring", "hole", place.alias("place"), F.col("x1").alias("x"), F.col("y1").alias("y"))


def areas(rings: DataFrame, key: str = "label") -> DataFrame:
    """Signed area, corners and length of each ring: key, polygon, ring, hole, area, corners, length."""
    along = Window.partitionBy("ring").orderBy("place")
    whole = Window.partitionBy("ring").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(x).over(along), F.first(x).over(whole)) for x in "xy")
    sides = rings.withColumns({"nx": nx, "ny": ny})
    return sides.groupBy(key, "polygon", "ring", "hole").agg(
        (F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"), F.count(F.lit(1)).alias("corners"), F.sum(F.abs(F.col("nx") - F.col("x")) + F.abs(F.col("ny") - F.col("y"))).alias("length")
    )
