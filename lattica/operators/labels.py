"""Rules of labels: classification by polygons and thresholds, overlays, timelines.

Labels have label_id, name, type (point, similarity, polygon), visible, threshold, and
embedding, vertices (grid coordinates) or pixel_coords, which may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import l2sq, once
from ..model import Grid
from ..session import small
from . import geom, search


def classify(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Class of every pixel: the last polygon that holds it, else the nearest source within its threshold, else -1.

    Classes are numbered by the first visible label with an embedding; equal distances
    go to the earlier label.
    """
    active = labels.where("visible and embedding is not null")
    order = active.groupBy("name").agg(F.min("label_id").alias("at"))
    numbered = order.withColumn("class", F.row_number().over(Window.partitionBy().orderBy("at")) - 1)
    # frozen sets of pixels stay behind
    active = small(active.join(numbered.select("name", "class"), "name").select("label_id", "name", "class", "type", "threshold", "embedding", "vertices"))
    shapes = active.where("type = 'polygon' and vertices is not null").select(F.struct("label_id", "class").alias("polygon"), "vertices")
    inside = geom.rasterise(pixels.select("idx", "px", "py"), shapes).groupBy("idx").agg(F.max_by("polygon.class", "polygon.label_id").alias("by_polygon"))
    sources = active.where("threshold > 0").select("label_id", "class", "threshold", F.col("embedding").alias("source"))
    given = sources.select("label_id", "class", F.col("source").alias("emb"), (F.col("threshold") * F.col("threshold")).alias("t2"))
    blocks, n = search.packed_blocks(given, ("emb", "t2", "label_id", "class"))
    each = F.transform("queries", lambda q: F.struct(l2sq(F.col("emb"), q["emb"]).alias("d2"), q["label_id"].alias("label_id"), q["class"].alias("class"), q["t2"].alias("t2")))
    best = F.array_min(F.filter(each, lambda x: x["d2"] <= x["t2"]))
    near = pixels.join(blocks, how="left").select("idx", "px", "py", once(best).alias("best"))  # one pass where there is one block
    if n > 1:
        near = near.groupBy("idx", "px", "py").agg(F.min("best").alias("best"))
    return near.join(inside, "idx", "left").select("idx", "px", "py", F.coalesce("by_polygon", "best.class", F.lit(-1)).alias("class"))


def class_threshold(labels: DataFrame) -> DataFrame:
    """Threshold of each class: that of its first label that has one, else 0."""
    first = F.min_by(F.when(F.col("threshold") > 0, F.col("threshold")), F.when(F.col("threshold") > 0, F.col("label_id")))
    return labels.groupBy("name").agg(F.coalesce(first, F.lit(0.0)).alias("threshold"))


def set_threshold(labels: DataFrame, name: str, threshold: float | None) -> DataFrame:
    """A new threshold, 0 to 35, for a class, whose frozen pixels go; none keeps the old ones."""
    if threshold is None or threshold != threshold:
        return labels
    mine = F.col("name") == name
    value = F.lit(max(0.0, min(35.0, float(threshold))))
    frozen = labels.schema["pixel_coords"].dataType
    return labels.withColumns({"threshold": F.when(mine, value).otherwise(F.col("threshold")), "pixel_coords": F.when(mine, F.lit(None).cast(frozen)).otherwise(F.col("pixel_coords"))})


def overlay(pixels: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Pixels that a class covers, and how many matches its labels have together.

    Points, polygons and frozen sets cover theirs; only where no set is frozen, pixels
    near an embedding do too. Points are not counted as matches.
    """
    mine = labels.where((F.col("name") == name) & F.col("visible"))
    at = ["idx", "px", "py"]
    points = pixels.join(small(mine.where("type = 'point' and pixel is not null").select("pixel.px", "pixel.py")), ["px", "py"]).select(at)
    shapes = geom.rasterise(pixels.select(at), mine.where("type = 'polygon'").select(F.col("label_id").alias("polygon"), "vertices")).select(at)
    frozen = pixels.join(mine.select(F.inline("pixel_coords")), ["px", "py"]).select(at)
    counted = shapes.unionByName(frozen)
    if mine.where("pixel_coords is not null").limit(1).count() == 0:
        queries = mine.where("embedding is not null and threshold > 0").select(F.col("embedding").alias("emb"), (F.col("threshold") * F.col("threshold")).alias("t2"))
        counted = counted.unionByName(search.multi_search(pixels, queries).select(at))
    return counted.unionByName(points).distinct(), counted.count()


def timeline(years: DataFrame, seeds: DataFrame, grid: Grid) -> DataFrame:
    """Matches of each year (year, idx, px, py, emb) to the seeds (lat, lon, threshold) as they look in that year.

    A seed is read anew at its place; years without any give 0.
    """
    placed = small(seeds.select(grid.column(F.col("lon")).alias("sx"), grid.row(F.col("lat")).alias("sy"), "threshold", F.monotonically_increasing_id().alias("seed")))
    ring = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for k, (x, y) in enumerate(search.NEIGHBOURS)))
    tried = placed.select("seed", "threshold", "sx", "sy", F.inline(ring)).select("seed", "threshold", "ord", (F.col("sx") + F.col("dx")).alias("px"), (F.col("sy") + F.col("dy")).alias("py"))
    read = years.join(tried, ["px", "py"]).groupBy("year", "seed", "threshold").agg(F.min_by("emb", "ord").alias("source"))
    hits = years.select("year", "idx", "emb").join(small(read), "year").where(l2sq("emb", "source") <= F.col("threshold") * F.col("threshold"))
    counted = hits.groupBy("year").agg(F.count_distinct("idx").alias("n"))
    return years.select("year").distinct().join(counted, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def timeline_change(counts: DataFrame) -> DataFrame:
    """Change from the first to the last year in percent, one decimal; null where the first has none."""
    ends = counts.agg(F.min_by("n", "year").alias("first_n"), F.max_by("n", "year").alias("last_n"))
    return ends.withColumn("change_pct", F.when(F.col("first_n") > 0, F.round((F.col("last_n") - F.col("first_n")) / F.col("first_n") * 100, 1)))


def recomputed(pixels: DataFrame, labels: DataFrame, grid: Grid) -> DataFrame:
    """Pixels of saved labels: the frozen set, else matches of the stored embedding, else of the one at its place."""
    at = labels.where("pixel_coords is null and embedding is null and lat is not null").select(F.col("label_id").alias("probe"), "lat", "lon")
    read = search.extract(pixels, at, grid).select(F.col("probe").alias("label_id"), F.col("emb").alias("read"))
    source = F.coalesce("embedding", "read")
    given = labels.where("pixel_coords is null").join(read, "label_id", "left").where(source.isNotNull())
    blocks, _ = search.packed_blocks(given.select("label_id", source.alias("emb"), (F.col("threshold") * F.col("threshold")).alias("t2")), ("label_id", "emb", "t2"))
    hits = F.filter("queries", lambda q: l2sq(F.col("emb"), q["emb"]) <= q["t2"])
    each = pixels.select("idx", "emb").crossJoin(blocks).select("idx", F.explode(F.transform(hits, lambda q: q["label_id"])).alias("label_id"))
    near = each.select("label_id", "idx")
    frozen = labels.select("label_id", F.inline("pixel_coords")).join(pixels.select("idx", "px", "py"), ["px", "py"]).select("label_id", "idx")
    return near.unionByName(frozen)


def add(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels with more of them, numbered on from the largest id; a threshold of 0 takes the class's."""
    top = labels.agg(F.coalesce(F.max("label_id"), F.lit(0)).alias("top"))
    inherited = class_threshold(labels).withColumnRenamed("threshold", "of_class")
    more = new.drop("label_id").crossJoin(F.broadcast(top)).join(F.broadcast(inherited), "name", "left")
    number = F.row_number().over(Window.partitionBy().orderBy("name", "type")) + F.col("top")
    more = more.withColumn("label_id", number.cast(labels.schema["label_id"].dataType)).withColumn("threshold", F.when(F.coalesce("of_class", F.lit(0.0)) > 0, F.col("of_class")).otherwise(F.col("threshold")))
    return labels.unionByName(more.select(*new.columns, *([] if "label_id" in new.columns else ["label_id"])), allowMissingColumns=True)


def rename(labels: DataFrame, old: str, new: str) -> DataFrame:
    return labels.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))


def remove(labels: DataFrame, name: str) -> DataFrame:
    return labels.where(~F.col("name").eqNullSafe(name))


def toggle(labels: DataFrame, name: str | None, visible: bool) -> DataFrame:
    """Visibility of a class, or of all."""
    return labels.withColumn("visible", F.lit(visible) if name is None else F.when(F.col("name") == name, visible).otherwise(F.col("visible")))


def merged(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """Saved labels with the imported ones whose ids are new; those without id or name are skipped."""
    fresh = incoming.where("label_id is not null and name is not null").join(saved.select("label_id"), "label_id", "left_anti")
    return saved.unionByName(fresh)


def coloured(points: DataFrame, classes: DataFrame) -> DataFrame:
    """Colours of points (idx), the last class's (idx, ord, colour) where several hold one."""
    top = classes.groupBy("idx").agg(F.max_by("colour", "ord").alias("colour"))
    return points.join(top, "idx", "left")


def label_at(labels: DataFrame, px: int, py: int) -> DataFrame:
    """The first label whose frozen set has a pixel."""
    hit = F.exists("pixel_coords", lambda p: (p["px"] == px) & (p["py"] == py))
    return labels.where(hit).orderBy("label_id").limit(1)


def colour_index(values: Column, over: DataFrame, palette: int = 20) -> DataFrame:
    """Distinct values in order, each with its place in a palette."""
    seen = over.select(values.alias("value")).where("value is not null").distinct()
    return seen.withColumn("colour", (F.dense_rank().over(Window.partitionBy().orderBy("value")) - 1) % palette)
