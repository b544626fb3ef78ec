"""Polygons and runs on the pixel grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small


#: Pixels of a row that make a cell, and the longest array by which a run of numbers is dealt out.
CELL, STEPS = 64, 4096


def edges(polygons: DataFrame, *keys: str) -> DataFrame:
    """Sides of polygons (polygon, vertices: array of struct x, y): polygon, ``keys``, x1, y1, x2, y2."""
    v = F.col("vertices")
    pairs = F.zip_with(v, F.concat(F.slice(v, F.size(v), 1), F.slice(v, F.lit(1), F.size(v) - 1)), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))
    return polygons.select("polygon", *keys, F.inline(pairs))


def contains(x: Column, y: Column, vertices: Column) -> Column:
    """Whether one place lies in one polygon: the even-odd rule, with half-open sides."""
    before = F.concat(F.slice(vertices, F.size(vertices), 1), F.slice(vertices, F.lit(1), F.size(vertices) - 1))

    def crosses(a: Column, b: Column) -> Column:
        spans = (a.y > y) != (b.y > y)
        at = (b.x - a.x) * (y - a.y) / F.nullif(b.y - a.y, F.lit(0.0)) + a.x
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(vertices, before, crosses), F.lit(0), lambda s, k: s + k) % 2 == 1


def stepped(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """A row for each whole number from ``low`` to ``high``; long runs are dealt out by parts, so that no array is long."""
    bounded = df.withColumns({"__low": low.cast("long"), "__high": high.cast("long")}).where("__low <= __high")
    parts = bounded.withColumn("__part", F.explode(F.expr(f"sequence(0L, (__high - __low) div {STEPS})")))
    start = F.col("__low") + F.col("__part") * STEPS
    return parts.withColumn(name, F.explode(F.sequence(start, F.least(F.col("__high"), start + (STEPS - 1))))).drop("__low", "__high", "__part")


def spans(polygons: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Runs of pixels whose centres lie in a polygon: polygon, py, and the run's px from ``first`` to ``last``.

    Each side meets the rows that it crosses; in a row, the crossings in order of x begin
    and end the runs (the even-odd rule, with half-open sides). ``box`` (x0, y0, x1, y1,
    the last ones included) bounds the pixels. Polygons have three vertices or more;
    a polygon given twice with the same vertices counts once.
    """
    x0, y0, x1, y1 = box or (None,) * 4
    shapes = polygons.where(F.size("vertices") >= 3).select("polygon", "vertices").distinct().withColumn("shape", F.xxhash64("vertices"))
    sides = edges(shapes, "shape").withColumns({"low": F.ceil(F.least("y1", "y2") - 0.5), "high": F.ceil(F.greatest("y1", "y2") - 0.5) - 1})
    low = F.col("low") if box is None else F.greatest("low", F.lit(y0))
    high = F.col("high") if box is None else F.least("high", F.lit(y1))
    y = F.col("py") + 0.5
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    met = stepped(sides, low, high, "py").where((F.col("y1") > y) != (F.col("y2") > y)).select("polygon", "shape", "py", at.alias("at"))
    along = Window.partitionBy("polygon", "shape", "py").orderBy("at")
    pairs = met.withColumns({"to": F.lead("at").over(along), "n": F.row_number().over(along)}).where("n % 2 = 1")
    first, last = F.ceil(F.col("at") - 0.5), F.ceil(F.col("to") - 0.5) - 1
    if box is not None:
        first, last = F.greatest(first, F.lit(x0)), F.least(last, F.lit(x1))
    return pairs.select("polygon", "py", first.alias("first"), last.alias("last")).where("first <= last")


def cover(polygons: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells of CELL pixels of one row that polygons touch: polygon, py, cell, and which of the cell's pixels, first to last, are inside."""
    runs = spans(polygons, box)
    cells = stepped(runs, F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL), "cell")
    start = F.col("cell") * CELL
    return cells.withColumns({"first": F.greatest("first", start), "last": F.least("last", start + (CELL - 1))})


def rasterise(pixels: DataFrame, polygons: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels whose centre lies in a polygon of three vertices or more: adds polygon.

    Polygons are covered by cells, and pixels meet the polygons of their own cell only: an
    equi-join, as large as the result. What a cell has inside is a run, so that whole
    cells and those at an edge need the same two comparisons. ``box`` as in spans().
    """
    cells = small(cover(polygons, box).withColumnsRenamed({"py": "__py", "cell": "__cell", "first": "__first", "last": "__last"}), 20_000)
    own = pixels.withColumn("__own", F.floor(F.col("px") / CELL))
    met = (F.col("py").cast("long") == F.col("__py")) & (F.col("__own") == F.col("__cell")) & F.col("px").between(F.col("__first"), F.col("__last"))
    return own.join(cells, met).select(*pixels.columns, "polygon")


def run_rectangles(cells: DataFrame, key: str = "label") -> DataFrame:
    """Rows of adjacent pixels (key, px, py) as rectangles; right and bottom edges exclusive."""
    order = Window.partitionBy(key, "py").orderBy("px")
    islands = cells.select(key, "px", "py").distinct().withColumn("island", F.col("px") - F.row_number().over(order))
    found = islands.groupBy(key, "py", "island").agg(F.min("px").alias("x0"), (F.max("px") + 1).alias("x1"))
    return found.select(key, "x0", F.col("py").alias("y0"), "x1", (F.col("py") + 1).alias("y1"))


def boundary(cells: DataFrame, key: str = "label") -> DataFrame:
    """Unit sides between pixels of a set and others, each once: the outline's pieces."""
    side = lambda dx1, dy1, dx2, dy2: F.struct((F.col("px") + dx1).alias("x1"), (F.col("py") + dy1).alias("y1"), (F.col("px") + dx2).alias("x2"), (F.col("py") + dy2).alias("y2"))
    sides = cells.select(key, "px", "py").distinct().select(key, F.inline(F.array(side(0, 0, 1, 0), side(0, 1, 1, 1), side(0, 0, 0, 1), side(1, 0, 1, 1))))
    return sides.groupBy(key, "x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def vertex_mean(polygons: DataFrame) -> DataFrame:
    mean = lambda k: F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v[k]) / F.size("vertices")
    return polygons.select("polygon", mean("x").alias("x"), mean("y").alias("y"))


def overlaps(a: str, b: str) -> Column:
    """Whether two boxes (west, south, east, north of structs) share some area."""
    return F.expr(f"{a}.west < {b}.east and {a}.east > {b}.west and {a}.south < {b}.north and {a}.north > {b}.south")


def geojson_box(documents: DataFrame) -> DataFrame:
    """West, south, east and north of all places in the features of GeoJSON texts ``value``; pairs beyond the globe are passed over."""
    kind = "struct<features:array<struct<geometry:struct<coordinates:string>>>>"
    features = documents.select(F.explode(F.from_json("value", kind)["features"]).alias("f")).where("f.geometry.coordinates is not null")
    found = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"))
    numbers = features.select(F.transform(found, lambda x: x.cast("double")).alias("x")).where("size(x) > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("x") / 2).cast("int")), lambda i: F.struct(F.element_at("x", 2 * i - 1).alias("lon"), F.element_at("x", 2 * i).alias("lat")))
    at = numbers.select(F.inline(pairs)).where("abs(lat) <= 90 and abs(lon) <= 180")
    box = at.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    return box.where("west is not null")


def box_order(box: DataFrame) -> DataFrame:
    """A box as the list that splits take: south, west, north, east."""
    return box.select(F.array("south", "west", "north", "east").alias("box"))
