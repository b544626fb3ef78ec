"""The registered queries of the engine, over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import grid as g
from .functions import text as tx
from .functions.vec import bounds, by_dimension, dequantise, l2sq, literal, mean_vector
from .model import GRID, pixels, second_year
from .operators import catalog, change, cluster, codebook, evaluate, fetch, geom, labels, pyramid, quant, raster, rings, search
from .plans import evaluation, ingest
from .plans.evaluation import labelled_pixels
from .session import scratch, small, stored
from .sinks import bundles
from .sinks import tables as sink_tables
from .sinks import texts
from .sources.labels import labels_from_export, labels_from_geojson, labels_from_table, read_labels
from .sources import arrays, shapes
from .sources.schemes import filter_scheme, scheme_from_lines, with_paths
from .sources.tables import codebook_config, read_codebooks, read_pixels, read_results, read_vectors
from .sources.viewports import parse_viewports
from .streaming import events as ev
from .streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

PROBES = ((1, 52.0, -1.0), (2, 52.0, -0.99), (3, 51.985, -0.955), (4, 52.005, -1.005), (5, 10.0, 10.0), (6, 51.93, -0.74))
SEEDS = (0, 7, 42)
TEXTS = (("Ab.c@d-e.org", "nn_v2", "#ff8000"), (" x@y.z ", "rf", "#abc"), ("!!", "mlp_v10", "rgb(1, 22, 255)"), ("q@q.q.q", "Name With Space", "red"))
SHAPE = ((2.0, 2.0), (22.0, 2.0), (22.0, 8.0), (12.0, 8.0), (12.0, 16.0), (2.0, 16.0))
TRIANGLE = ((14.0, 9.0), (24.0, 9.0), (19.0, 19.0))
#: Corners of a star around a pixel, which crosses itself, in parts of its radius.
STAR = ((0.0, -1.0), (0.6, 0.8), (-0.95, -0.3), (0.95, -0.3), (-0.6, 0.8))
TILE = 8
CODES = 7


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _vector(p: DataFrame, idx: int) -> Column:
    return literal(p.where(F.col("idx") == idx).first()["emb"])


def _seeds(p: DataFrame, threshold: float = 1.2) -> DataFrame:
    return p.where(F.col("idx").isin(*SEEDS)).select("emb", F.lit(threshold * threshold).alias("t2"))


def _r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def _polygons(spark: SparkSession) -> DataFrame:
    rows = [(k, [{"x": x, "y": y} for x, y in v]) for k, v in ((1, SHAPE), (2, TRIANGLE))]
    return spark.createDataFrame(rows, "polygon int, vertices array<struct<x:double,y:double>>")


# Search


@query
def grid_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the pixel under each probe, or its first neighbour there is."""
    probes = spark.createDataFrame(PROBES, "probe int, lat double, lon double")
    found = search.extract(pixels(spark, sf_dir), probes, GRID)
    return found.select("probe", "idx", "px", "py", F.round(F.col("emb")[0], 6).alias("first"), F.size("emb").alias("dims"))


@query
def sim_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels near the vector under a place, with positions and distances."""
    p = pixels(spark, sf_dir)
    probe = spark.createDataFrame(PROBES[:1], "probe int, lat double, lon double")
    vector = literal(search.extract(p, probe, GRID).first()["emb"])
    return search.range_search(p, vector, 1.3, GRID).select("idx", "px", "py", _r("lat"), _r("lon"), _r("distance"))


@query
def sim_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels near any of several vectors."""
    p = pixels(spark, sf_dir)
    return search.multi_search(p, _seeds(p))


@query
def sim_min_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    p = pixels(spark, sf_dir)
    return search.min_sq_distances(p, _seeds(p).select("emb")).select("idx", _r("d2"))


@query
def sim_rethreshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances computed once and cut at two thresholds."""
    p = pixels(spark, sf_dir)
    d = search.min_sq_distances(p, _seeds(p).select("emb"))
    both = d.select("idx", "d2", F.explode(literal((1.2, 1.25))).alias("threshold"))
    return search.matches(both, F.col("threshold")).select("threshold", "idx")


@query
def sim_count_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many pixels match any vector, each vector with its own threshold."""
    p = pixels(spark, sf_dir)
    own = p.where(F.col("idx").isin(*SEEDS)).select("emb", F.pow(F.lit(1.15) + (F.col("idx") % 3) * 0.05, 2).alias("t2"))
    return search.multi_search(p, own).agg(F.count(F.lit(1)).alias("n"))


@query
def sim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F10."""
    p = pixels(spark, sf_dir)
    s = search.match_stats(search.range_search(p, _vector(p, 0), 1.3, GRID), p.count())
    return s.select("n", *(_r(x, 4) for x in ("pct", "min_distance", "max_distance", "mean_distance")))


@query
def sim_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the ten nearest pixels, a top-k report."""
    p = pixels(spark, sf_dir)
    return search.nearest(p, _vector(p, 3), 10).select("idx", _r("d2"))


@query
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the point nearest to a place; none if it is too far."""
    at = pixels(spark, sf_dir).select("idx", GRID.lat(F.col("px"), F.col("py")).alias("lat"), GRID.lon(F.col("px"), F.col("py")).alias("lon"))
    near = search.nearest_place(at, 51.95003, -0.87002, 1e-4).select(F.lit("near").alias("which"), "idx")
    return near.unionByName(search.nearest_place(at, 51.9551, -0.87, 1e-4).select(F.lit("far").alias("which"), "idx")).unionByName(
        search.nearest_place(at, 51.9561, -0.8699).select(F.lit("any").alias("which"), "idx")
    )


@query
def bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    at = pixels(spark, sf_dir).select("idx", GRID.lat(F.col("px"), F.col("py")).alias("lat"), GRID.lon(F.col("px"), F.col("py")).alias("lon"))
    return search.inside(at, 51.9149, -0.9251, 51.9651, -0.8149).select("idx", _r("lat"), _r("lon"))


@query
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: the exact neighbour graph that a layout starts from, of every pixel whose id is divisible by 20."""
    p = pixels(spark, sf_dir)
    return cluster.knn_graph(p, p.where("idx % 20 = 0"), 5).select("source", "rank", "idx", _r("d2"))


@query
def knn_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: weights of the graph of all pixels' 15 neighbours; each source's sum, and its share of the undirected edges."""
    p = pixels(spark, sf_dir)
    found = stored(cluster.fuzzy_weights(cluster.knn_graph(p, p, 15)))
    edges = cluster.fuzzy_union(found)
    shares = edges.select(F.explode(F.array("a", "b")).alias("source"), F.col("weight").alias("w"))
    own = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"), F.max("weight").alias("top"))
    return own.join(shares.groupBy("source").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("mass")), "source").select("source", "n", _r("total", 5), _r("top"), "degree", _r("mass", 4))


# Vectors and quantisation


@query
def dim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return bounds(pixels(spark, sf_dir)).select(F.posexplode(F.arrays_zip("low", "high")).alias("dim", "b")).select("dim", F.round("b.low", 6).alias("low"), F.round("b.high", 6).alias("high"))


@query
def mean_vector_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, P4."""
    return by_dimension(mean_vector(pixels(spark, sf_dir), "label"), "label", "n").select("label", "n", "dim", F.round("value", 6).alias("mean"))


def _codes(q: DataFrame) -> DataFrame:
    return q.select("idx", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("codes"))


@query
def quantize_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1."""
    return _codes(quant.quantise_pixels(pixels(spark, sf_dir)))


@query
def quantize_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2."""
    return _codes(quant.quantise_pixels(pixels(spark, sf_dir), nearest=True))


@query
def dequant_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest error of each dimension, and whether it is within a step."""
    d = quant.decoded(quant.quantise_pixels(pixels(spark, sf_dir)))
    z = d.select(F.posexplode(F.arrays_zip("emb", "decoded", "low", "high")).alias("dim", "z"))
    worst = F.max(F.abs(F.col("z.emb") - F.col("z.decoded")))
    return z.groupBy("dim").agg(F.round(worst, 6).alias("max_error"), (worst <= F.max(F.col("z.high") - F.col("z.low")) / 255.0 + 1e-12).alias("within"))


@query
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3."""
    return quant.check_vectors(pixels(spark, sf_dir))


def _height(p: DataFrame) -> int:
    return p.agg(F.max("py")).first()[0] + 1


def _tiled(p: DataFrame, height: int) -> DataFrame:
    """Pixels with tile, and codes of two stages that follow from idx."""
    across = quant.tiles_along(GRID.width, TILE)
    tile = quant.tile_of(F.col("py"), height, TILE) * across + quant.tile_of(F.col("px"), GRID.width, TILE)
    return p.select("idx", "px", "py", "emb", tile.cast("int").alias("tile"), (F.col("idx") % CODES).cast("int").alias("i1"), (F.col("idx") % 3).cast("int").alias("i2"))


def _stages(p: DataFrame, height: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes of pixels; decoded codebooks of means by tile and first code, and of the rests' means."""
    codes = _tiled(p, height)
    first = mean_vector(codes.select("tile", F.col("i1").alias("code"), "emb"), "tile", "code")
    second = mean_vector(codes.select("tile", F.col("i2").alias("code"), F.transform("emb", lambda x: x * 0.1).alias("emb")), "tile", "code")
    decode = lambda book: quant.quantise_codebook(book).select("tile", "code", dequantise("q", "low", "high").alias("vec"))
    return codes.drop("emb"), decode(first), decode(second)


@query
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V6."""
    p = pixels(spark, sf_dir)
    return _tiled(p, _height(p)).select("idx", "tile")


@query
def vq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V3: codebooks quantised by tile and decoded again."""
    p = pixels(spark, sf_dir)
    return by_dimension(_stages(p, _height(p))[1], "tile", "code", vector="vec").select("tile", "code", "dim", F.round("value", 6).alias("value"))


@query
def rvq_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a cropped part from two stages."""
    p = pixels(spark, sf_dir)
    codes, first, second = _stages(p, _height(p))
    out = quant.reconstruct(codes.where("px between 3 and 12 and py between 2 and 17"), first, second)
    return out.select("idx", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.col("vec")[0], 6).alias("first"))


@query
def linear_fastpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: a projection of two stages by k products instead of one per pixel."""
    p = pixels(spark, sf_dir)
    codes, first, second = _stages(p, _height(p))
    weights = literal([1.0 / (k + 1) for k in range(64)])
    s1 = quant.projected(first, weights).select("tile", F.col("code").alias("i1"), F.col("score").alias("s1"))
    s2 = quant.projected(second, weights).select("tile", F.col("code").alias("i2"), F.col("score").alias("s2"))
    return codes.join(s1, ["tile", "i1"]).join(s2, ["tile", "i2"]).select("idx", F.round(F.col("s1") + F.col("s2"), 6).alias("score"))


@query
def vq_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: every vector as a tile of codes, five in a row; tiles overlap at the edges, later ones on top."""
    p = pixels(spark, sf_dir)
    codes = F.transform("emb", lambda x: F.floor((x + 1) * 100).cast("int"))
    tiles = p.select(F.floor(F.col("idx") / 5).cast("int").alias("row"), (F.col("idx") % 5).cast("int").alias("col"), F.col("idx").alias("ord"), codes.alias("codes"))
    rows = -(-(p.agg(F.max("idx")).first()[0] + 1) // 5)
    return quant.assemble(tiles, rows * 8 - 2, 5 * 8 - 3, 8).select("px", "py", "code")


# Change


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return change.change(p, second_year(p))


@query
def change_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return _changes(spark, sf_dir).select("idx", "px", "py", _r("distance"))


@query
def change_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return change.change_stats(_changes(spark, sf_dir)).select("matched", *(_r(f"{x}_distance") for x in ("min", "max", "mean", "median")))


@query
def change_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return change.change_bins(_changes(spark, sf_dir)).select("bin", "label", _r("lo"), _r("hi"), "n", _r("pct", 1))


@query
def change_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour of each pixel's change, from 0 to one and a half medians."""
    found = stored(_changes(spark, sf_dir).select("idx", "distance"))
    top = F.lit((change.median(found) or 0.0) * 1.5)
    v = F.when(top > 0, F.least(F.lit(1.0), F.col("distance") / F.nullif(top, F.lit(0.0)))).otherwise(0.0)
    return found.select("idx", *(g.viridis(v, k).alias(n) for k, n in enumerate("rgb")))


# Geometry and raster


@query
def polygon_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2, J7."""
    return geom.rasterise(pixels(spark, sf_dir), _polygons(spark)).select("polygon", "idx", "px", "py")


@query
def polygon_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    m = mean_vector(geom.rasterise(pixels(spark, sf_dir), _polygons(spark)), "polygon")
    return by_dimension(m, "polygon", "n").select("polygon", "n", "dim", F.round("value", 6).alias("mean"))


@query
def polygon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors inside a polygon as queries."""
    p = pixels(spark, sf_dir)
    inside = geom.rasterise(p, _polygons(spark)).where("polygon = 2").select("emb", F.lit(1.0).alias("t2"))
    return search.multi_search(p, inside)


def _stars(p: DataFrame) -> DataFrame:
    """A polygon for every pixel: a star around its place, of five sizes."""
    r = 1.5 + (F.col("idx") % 5) * 0.75
    corner = lambda x, y: F.struct((F.col("px") + 0.63 + r * x).alias("x"), (F.col("py") + 0.57 + r * y).alias("y"))
    return p.select(F.col("idx").alias("polygon"), F.array(*(corner(x, y) for x, y in STAR)).alias("vertices"))


@query
def polygon_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many polygons as pixels, joined by cells; pixels and the mean of their first dimension inside each."""
    p = pixels(spark, sf_dir).select("idx", "px", "py", F.col("emb")[0].alias("first"))
    inside = geom.rasterise(p, _stars(p))
    return inside.groupBy("polygon").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("total"), F.round(F.avg("first"), 6).alias("mean"))


@query
def outline_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rings around each label's pixels; their areas, corners and lengths, and rings less holes."""
    found = rings.areas(rings.outlines(pixels(spark, sf_dir)))
    return found.groupBy("label").agg(
        F.sum("area").cast("long").alias("area"), F.sum("corners").alias("corners"), F.sum("length").cast("long").alias("length"), F.sum(F.when(F.col("hole"), -1).otherwise(1)).alias("outer_less_holes")
    )


@query
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one label as rectangles in degrees."""
    return texts.run_features(pixels(spark, sf_dir), GRID).select("label", _r("west"), _r("south"), _r("east"), _r("north"))


@query
def outline_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit sides of the outline of each label's pixels."""
    return geom.boundary(pixels(spark, sf_dir))


@query
def vertex_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a label for every pixel's star."""
    return geom.vertex_mean(_stars(pixels(spark, sf_dir))).select("polygon", _r("x"), _r("y"))


@query
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1."""
    return raster.stretched(pixels(spark, sf_dir)).select("idx", "band0", "band1", "band2")


@query
def pyramid_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2."""
    p = pixels(spark, sf_dir)
    return raster.level(p.select("idx", "px", "py"), GRID.width, _height(p), 2).select("col", "row", "idx")


@query
def enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel three times along both sides."""
    return raster.enlarged(pixels(spark, sf_dir).select("idx", "px", "py"), 3).select("idx", "px", "py")


@query
def tile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of the image stretched to a tile."""
    return raster.window(pixels(spark, sf_dir).select("idx", "px", "py"), GRID, -0.95, 51.85, -0.87, 51.95, 16).select("col", "row", "idx")


def _images(p: DataFrame) -> DataFrame:
    """Size and transform of one viewport's image in two years."""
    return p.agg((F.max("py") + 1).alias("height")).select(
        F.lit("here").alias("viewport"), F.explode(F.array(F.lit(2023), F.lit(2024))).alias("year"), F.lit(GRID.width).alias("width"), "height",
        F.lit(GRID.a).alias("a"), F.lit(GRID.c).alias("c"), F.lit(GRID.e).alias("e"), F.lit(GRID.f).alias("f"),
    )


def _levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every level of two years' images as a table, and the table of their sizes."""
    p = pixels(spark, sf_dir)
    images = _images(p)
    image = p.select(F.lit("here").alias("viewport"), F.explode(F.array(F.lit(2023), F.lit(2024))).alias("year"), "px", "py", F.col("label").alias("band"), "idx")
    path = scratch(spark, "levels")
    pyramid.write_levels(pyramid.levels(image, images), path)
    return spark.read.parquet(path), pyramid.sizes(images)


@query
def image_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: every level of two images in one table."""
    found, _ = _levels(spark, sf_dir)
    return found.select("viewport", F.col("year").cast("int").alias("year"), F.col("level").cast("int").alias("level"), "col", "row", "band", "idx")


@query
def tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map tile around every pixel, at seven zooms, and one of a year that is not there."""
    found, levels_of = _levels(spark, sf_dir)
    z = (F.lit(8) + F.col("idx") % 7).cast("int")
    at = pixels(spark, sf_dir).select("idx", z.alias("z"), GRID.lat(F.col("px"), F.col("py")).alias("lat"), GRID.lon(F.col("px"), F.col("py")).alias("lon"))
    tile = at.select("idx", "z", g.tile_x(F.col("lon"), F.col("z")).alias("x"), g.tile_y(F.col("lat"), F.col("z")).alias("y"))
    requests = tile.select(F.lit("here").alias("viewport"), (F.lit(2023) + F.col("idx") % 3).cast("int").alias("year"), "z", "x", "y").distinct()
    shown = pyramid.tiles(found, levels_of, requests, 16)
    counted = shown.groupBy("year", "z", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("idx") * (F.col("tile_col") + 16 * F.col("tile_row"))).alias("total"))
    return requests.join(counted, ["year", "z", "x", "y"], "left").select(F.col("year").cast("int").alias("year"), "z", "x", "y", F.coalesce("n", F.lit(0)).alias("n"), "total")


@query
def image_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box and centre of each image, from its level 0."""
    found = pyramid.bounds(pyramid.sizes(_images(pixels(spark, sf_dir))))
    return found.select("viewport", "year", *(_r(x) for x in ("west", "south", "east", "north", "center_lat", "center_lon")))


@query
def point_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request around every pixel, some of them bad, by a registry of tiles of 8 x 8 pixels; what each gets, and from which origin."""
    p = pixels(spark, sf_dir)
    tile = (F.floor(F.col("py") / 8) * 4 + F.floor(F.col("px") / 8)).cast("int")
    path = scratch(spark, "tiles")
    p.select("idx", tile.alias("tile"), GRID.lat(F.col("px"), F.col("py")).alias("lat"), GRID.lon(F.col("px"), F.col("py")).alias("lon")).write.partitionBy("tile").parquet(path)
    x, y = (F.col("tile") % 4) * 8, F.floor(F.col("tile") / 4) * 8
    corner = F.struct(GRID.lon(x, y).alias("lon"), GRID.lat(x, y).alias("lat"), F.lit(GRID.a).alias("dx"), F.lit(GRID.e).alias("dy"))
    state = F.when(F.col("tile") % 5 == 3, "slow").when(F.col("tile") % 5 == 4, "broken").otherwise("ready")
    registry = p.select(tile.alias("tile")).distinct().select(
        "tile", GRID.lon(x, y).alias("west"), GRID.lat(x, y + 8).alias("south"), GRID.lon(x + 8, y).alias("east"), GRID.lat(x, y).alias("north"),
        F.when(F.col("tile") % 2 == 0, corner).alias("origin"), state.alias("state"),
    )
    lat, lon = GRID.lat(F.col("px"), F.col("py")) - 0.003, GRID.lon(F.col("px"), F.col("py")) + 0.003
    points = p.select(F.col("idx").alias("point"), F.when(F.col("idx") % 17 == 0, 95.0).when(F.col("idx") % 23 != 0, lat).alias("lat"), F.when(F.col("idx") % 19 == 0, lon + 10).otherwise(lon).alias("lon"))
    found = fetch.outcomes(points, registry, 3.0, 3.0, 0.1)
    counted = fetch.fetched(found, spark.read.parquet(path)).groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("total"))
    return found.join(counted, "point", "left").select("point", "status", "tile", F.round("origin.lon", 6).alias("origin_lon"), _r("west"), _r("north"), F.coalesce("n", F.lit(0)).alias("n"), "total")


@query
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5."""
    p = pixels(spark, sf_dir)
    return raster.crop(p, GRID, -0.9451, 51.8951, -0.8549, 51.9549, _height(p)).select("idx", "px", "py")


@query
def tile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner of a map tile for every pixel, and the image level for its zoom."""
    t = pixels(spark, sf_dir).select("idx", (F.lit(6) + F.col("idx") % 12).cast("int").alias("z"))
    side = F.pow(F.lit(2.0), F.col("z")).cast("long")
    x, y = (F.col("idx") * 3) % side, (F.col("idx") * 2 + 1) % side
    return t.select("idx", "z", F.round(g.tile_lon(x, F.col("z")), 6).alias("west"), F.round(g.tile_lat(y, F.col("z")), 6).alias("north"), g.pyramid_level(F.col("z")).alias("level"))


@query
def pixel_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P6."""
    at = pixels(spark, sf_dir).select("idx", GRID.lat(F.col("px"), F.col("py")).alias("lat"), GRID.lon(F.col("px"), F.col("py")).alias("lon"))
    return raster.pixel_bounds(at, GRID).select("idx", _r("west"), _r("south"), _r("east"), _r("north"))


@query
def viewport_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box around every pixel's place, and its size on disk for one to three years."""
    p = pixels(spark, sf_dir)
    at = p.select("idx", GRID.lat(F.col("px"), F.col("py")).alias("lat"), GRID.lon(F.col("px"), F.col("py")).alias("lon"))
    w, s, e, n = g.box_around(F.col("lat"), F.col("lon"), 10, 6)
    boxes = at.select("idx", w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    mb = g.estimated_mb(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("idx") % 3 + 1)
    return boxes.select("idx", _r("west"), _r("south"), _r("east"), _r("north"), F.round(mb, 3).alias("mb"))


# Tables written and read again


@query
def pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels by viewport and year; one viewport's year and box read back."""
    p = pixels(spark, sf_dir)
    years = [x.select(F.concat(F.lit("v"), F.col("idx") % 3).alias("viewport_id"), F.lit(y).alias("year"), "py", "px", "idx", "emb") for y, x in ((2023, p), (2024, second_year(p)))]
    path = scratch(spark, "pixels")
    sink_tables.write_pixels(years[0].unionByName(years[1]), path)
    return read_pixels(spark, path, "v1", [2024], (3, 2, 20, 15)).select("idx", F.round(F.col("emb")[0], 6).alias("first"))


@query
def array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors written as array files and read again by byte ranges."""
    folder = scratch(spark, "arrays")
    arrays.write_vectors(pixels(spark, sf_dir), folder)
    return arrays.read_vectors(spark, folder).select("idx", F.size("emb").alias("width"), F.round(F.col("emb")[0], 6).alias("first"), F.round(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query
def codebook_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantised structure as tables, and what its pixels decode to."""
    p = pixels(spark, sf_dir)
    tiled = _tiled(p, _height(p))
    book = quant.quantise_codebook(mean_vector(tiled.select("tile", F.col("i1").alias("code"), "emb"), "tile", "code"))
    owned = lambda df: df.withColumns({"viewport_id": F.lit("v1"), "year": F.lit(2024)})
    folder = scratch(spark, "codebooks")
    sink_tables.write_codebooks(owned(book.drop("low", "high")), owned(book.groupBy("tile").agg(F.first("low").alias("low"), F.first("high").alias("high"))), owned(tiled.select("idx", "px", "py", "tile", "i1")), folder)
    first, codes = read_codebooks(spark, folder, "v1", 2024)
    return quant.reconstruct(codes, first).select("idx", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query
def codebook_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: codebooks of two stages by tile; squared distances to the tile's mean, and whether no stage adds to them."""
    p = pixels(spark, sf_dir)
    tiled = _tiled(p, _height(p)).select("idx", "tile", "emb")
    codes, first, second = codebook.train_stages(tiled, codebook_config({"k": 5, "k2": 4}))
    mean = mean_vector(tiled, "tile").select("tile", F.col("emb").alias("mean"))
    one, two = (b.select("tile", F.col("code").alias(i), F.col("vec").alias(v)) for b, i, v in ((first, "i1", "v1"), (second, "i2", "v2")))
    seen = tiled.join(codes, ["idx", "tile"]).join(small(one), ["tile", "i1"]).join(small(two), ["tile", "i2"]).join(small(mean), "tile")
    both = F.zip_with("v1", "v2", lambda a, b: a + b)
    sums = seen.groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(l2sq("emb", c)).alias(a) for c, a in (("mean", "s0"), ("v1", "s1"), (both, "s2"))),
    )
    sizes = first.groupBy("tile").agg(F.count(F.lit(1)).cast("int").alias("codes"))
    falls = (F.col("s1") <= F.col("s0") + 1e-9) & (F.col("s2") <= F.col("s1") + 1e-9)
    return sums.join(sizes, "tile").select("tile", "n", "codes", F.round("s0", 4).alias("spread"), falls.alias("lessens"))


@query
def vector_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years kept as codebooks, as bytes and as vectors, each read by the first of its tables."""
    p = pixels(spark, sf_dir)
    folder = scratch(spark, "vectors")
    owned = lambda df, year: df.withColumns({"viewport_id": F.lit("v1"), "year": F.lit(year)})
    sink_tables.write_pixels(owned(p, 2022).unionByName(owned(p, 2023)).drop("label"), f"{folder}/pixel")
    coded, scales = ingest.quantised_years(owned(p, 2023).drop("label"))
    sink_tables.write_pixels(coded, f"{folder}/pixel_byte")
    scales.write.partitionBy("viewport_id", "year").parquet(f"{folder}/pixel_byte_scale")
    tiled = _tiled(p, _height(p))
    book = quant.quantise_codebook(mean_vector(tiled.select("tile", F.col("i1").alias("code"), "emb"), "tile", "code"))
    ends = book.groupBy("tile").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    sink_tables.write_codebooks(owned(book.drop("low", "high"), 2024), owned(ends, 2024), owned(tiled.select("idx", "px", "py", "tile", "i1"), 2024), folder)
    out = None
    for year in (2022, 2023, 2024):
        low, high = (F.aggregate(x, F.lit(0.0), lambda s, v: s + v) for x in ("low", "high"))
        row = read_vectors(spark, folder, "v1", year).select(F.lit(year).alias("year"), "idx", F.size("q").alias("dims"), F.round(low, 5).alias("low"), F.round(high, 5).alias("high"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point labels of CSV files with quotes and line ends in fields."""
    path = scratch(spark, "labels") + ".csv"
    rows = _events(spark, sf_dir).select(
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('a, "'), "event_type", F.lit('"\nb'))).otherwise(F.col("event_type")).alias("Name"),
        F.when(F.col("event_id") % 6 == 0, "abc").otherwise(F.col("value").cast("string")).alias("lat"),
        F.col("user_id").alias("lon"),
        (F.col("event_id") % 3).alias("code"),
    )
    rows.write.csv(path, header=True, escape='"')
    found = read_labels(spark, path)
    return found.groupBy("name", "code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("lon"), 4).alias("lon"))


@query
def event_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines, and read as such."""
    path = scratch(spark, "events")
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("event"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), F.col("user_id") % 5)).alias("model"), F.col("value").alias("score"))
    texts.write_events(rows, path)
    found = ev.parse_lines(spark.read.text(path))
    return found.groupBy("event", "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query
def geojson_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of all features, in the order that splits take."""
    feature = '{"type":"Feature","geometry":{"type":"%s","coordinates":%s}}'
    point, line = feature % ("Point", "[%d.25,-%d.5]"), feature % ("LineString", "[[%d,95],[-%d,%d]]")
    text = F.format_string('{"features":[' + point + "," + line + ',{"type":"Feature","geometry":null}]}', F.col("px") - 3, "py", "px", F.col("px") % 7, F.col("py") % 80)
    return geom.box_order(geom.geojson_box(pixels(spark, sf_dir).select(text.alias("value")))).select(*(F.col("box")[k].alias(x) for k, x in enumerate(("south", "west", "north", "east"))))


@query
def place_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that meet points of another source by places of six decimals."""
    p = pixels(spark, sf_dir)
    key = lambda shift: g.place_key(GRID.lat(F.col("px"), F.col("py")) + shift, GRID.lon(F.col("px"), F.col("py")))
    other = p.where("idx % 3 = 0").select(key(F.when(F.col("idx") % 2 == 0, 1e-8).otherwise(2e-6)).alias("key"), F.col("label").alias("colour"))
    return p.select("idx", key(F.lit(0.0)).alias("key")).join(other, "key").select("idx", "key", "colour")


@query
def class_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all pixels by a model of the labelled ones, as a raster."""
    p = pixels(spark, sf_dir)
    return evaluation.class_map(p.where("idx % 5 <> 0"), p.where("idx % 5 = 0")).select("px", "py", F.col("class_id").cast("int").alias("class_id"))


# Labels


def _centroids(p: DataFrame) -> DataFrame:
    return mean_vector(p, "label").select(F.col("label").alias("cluster"), F.col("emb").alias("centroid"))


def _labels(spark: SparkSession, p: DataFrame) -> DataFrame:
    """Six labels of three classes, with the vectors of pixels."""
    rows = [
        (1, "wood", "similarity", True, 1.25, 0, None, None), (2, "wood", "point", True, 0.0, 30, None, None), (3, "grass", "polygon", True, 1.2, 60, SHAPE, None),
        (4, "water", "similarity", True, 1.3, 90, None, None), (5, "grass", "polygon", True, 0.0, 120, TRIANGLE, None), (6, "water", "point", False, 1.3, 150, None, None),
        (7, "rock", "similarity", True, 1.0, 180, None, ((3, 3), (4, 3), (24, 19))),
    ]
    made = [(*x[:6], x[6] and [{"x": a, "y": b} for a, b in x[6]], x[7] and [{"px": a, "py": b} for a, b in x[7]]) for x in rows]
    kind = "label_id int, name string, type string, visible boolean, threshold double, idx long, vertices array<struct<x:double,y:double>>, pixel_coords array<struct<px:int,py:int>>"
    seeds = p.select("idx", F.col("emb").alias("embedding"), F.struct("px", "py").alias("pixel"))
    return spark.createDataFrame(made, kind).join(seeds, "idx").drop("idx")


@query
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return cluster.assign(p, _centroids(p)).select("idx", "cluster", _r("d2"))


@query
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1."""
    p = pixels(spark, sf_dir)
    return labels.classify(p, _labels(spark, p)).select("idx", F.col("class").cast("int").alias("class"))


@query
def class_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: pixels that each class covers."""
    p = pixels(spark, sf_dir)
    mine = _labels(spark, p)
    out = [labels.overlay(p, mine, name)[0].withColumn("name", F.lit(name)) for name in ("wood", "grass", "rock")]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("name", "idx")


@query
def class_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds before and after one class is set beyond the limit."""
    mine = _labels(spark, pixels(spark, sf_dir))
    before = labels.class_threshold(mine).withColumn("step", F.lit("before"))
    return before.unionByName(labels.class_threshold(labels.set_threshold(mine, "rock", 50.0)).withColumn("step", F.lit("after")))


@query
def label_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of seeds as they look in each of two years."""
    p = pixels(spark, sf_dir)
    years = p.select(F.lit(2023).alias("year"), "idx", "px", "py", "emb").unionByName(second_year(p).select(F.lit(2024).alias("year"), "idx", "px", "py", "emb"))
    seeds = spark.createDataFrame([(51.995, -0.995, 1.25), (51.955, -0.875, 1.3)], "lat double, lon double, threshold double")
    return labels.timeline(years, seeds, GRID)


@query
def label_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of saved labels, from frozen sets, stored vectors, or places."""
    p = pixels(spark, sf_dir)
    mine = _labels(spark, p).select("label_id", "threshold", "embedding", "pixel_coords", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    placed = spark.createDataFrame([(20, 1.25, 51.955, -0.875)], "label_id int, threshold double, lat double, lon double")
    return labels.recomputed(p, mine.unionByName(placed, allowMissingColumns=True), GRID)


@query
def label_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as export documents, one for each of their classes, written as text and read again with defaults."""
    p = pixels(spark, sf_dir)
    lat = F.when(F.col("idx") % 3 != 0, F.round(GRID.lat(F.col("px"), F.col("py")), 6))
    label = F.struct(F.col("idx").alias("id"), F.when(F.col("idx") % 4 != 0, F.concat(F.lit("n "), "label")).alias("name"), lat.alias("lat"), F.when(F.col("idx") % 5 == 0, F.lit(1.25)).alias("threshold"))
    documents = p.groupBy("label").agg(F.to_json(F.struct(F.collect_list(label).alias("labels"))).alias("value")).select("value")  # a document is one class
    path = scratch(spark, "labels")
    documents.write.text(path)
    found = labels_from_export(spark.read.text(path))
    return found.select("label_id", "name", "color", "type", "lat", "threshold", "visible")


@query
def viewport_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewport descriptions around every pixel, some of them wrong, and what is wrong with them."""
    at = pixels(spark, sf_dir).select("idx", GRID.lat(F.col("px"), F.col("py")).alias("lat"), GRID.lon(F.col("px"), F.col("py")).alias("lon"))
    number = lambda x: F.format_string("%.4f°", x)
    shift = F.when(F.col("idx") % 7 == 0, -0.1).otherwise(0.1)
    lines = (
        F.concat(F.lit("Viewport ID: v"), "idx"), F.concat(F.lit("Latitude: "), number(F.when(F.col("idx") % 11 == 0, 95.0).otherwise(F.col("lat")))), F.concat(F.lit("Longitude: "), number(F.col("lon"))),
        F.concat(F.lit("Min Latitude: "), number(F.col("lat") - shift)), F.when(F.col("idx") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("Max Latitude: "), number(F.col("lat") + shift))),
        F.concat(F.lit("Min Longitude: "), number(F.col("lon") - 0.2)), F.concat(F.lit("Max Longitude: "), number(F.col("lon") + 0.2)), F.when(F.col("idx") % 2 == 0, F.lit("Size: 7.5km")).otherwise(F.lit("")),
    )
    found = parse_viewports(at.select(F.concat_ws("\n", *lines).alias("value")))
    return found.select("viewport_id", _r("min_lat"), _r("max_lat"), "size_km", "problem")


@query
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of runs written as JSON, a folder for each field, year and task, and read again."""
    e = _events(spark, sf_dir)
    results = e.groupBy(F.col("event_type").alias("field"), (F.lit(2020) + F.col("user_id") % 3).cast("int").alias("year"), F.when(F.col("user_id") % 2 == 0, "classification").otherwise("regression").alias("task")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("score"), F.sort_array(F.collect_set(F.col("user_id") % 4)).alias("models")
    )
    path = scratch(spark, "results")
    sink_tables.write_results(results, path)
    found = read_results(spark, path)
    return found.select("field", F.col("year").cast("int").alias("year"), "task", "n", "score", F.size("models").alias("models"))


@query
def label_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels added, renamed, hidden and removed."""
    mine = _labels(spark, pixels(spark, sf_dir)).drop("embedding", "pixel", "vertices", "pixel_coords")
    new = spark.createDataFrame([("wood", "similarity", True, 0.0, 0), ("marsh", "point", True, 0.0, 0)], "name string, type string, visible boolean, threshold double, label_id int")
    out = labels.add(mine, new)
    out = labels.toggle(labels.rename(labels.remove(out, "water"), "rock", "stone"), "grass", False)
    return out.select("label_id", "name", "type", "visible", "threshold")


@query
def label_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of text as point labels, dirty ones left out."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" "), F.col("event_type"))).alias(" Name "),
        F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("LATITUDE"),
        F.col("user_id").cast("string").alias("Lng"),
    )
    return labels_from_table(rows).groupBy("name", "code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("lon"), 4).alias("lon"))


@query
def saved_label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported labels whose ids are new."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("label_id"), F.lit("saved").alias("name"))
    incoming = docs.select(F.col("doc_id").alias("label_id"), F.when(F.col("doc_id") % 7 != 0, "new").alias("name"))
    return labels.merged(known, incoming)


@query
def geojson_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of one document per pixel."""
    feature = '{"type":"Feature","geometry":{"type":"%s","coordinates":%s},"properties":{%s}}'
    point = feature % ("Point", "[%d.5,%d]", '"label":"p%d"')
    ring = feature % ("Polygon", "[[[0,0],[4,0],[4,%d],[0,0]]]", '"name":"","color":"#fff"')
    other = feature % ("MultiPolygon", "[]", "")
    value = F.format_string('{"type":"FeatureCollection","features":[' + point + "," + ring + "," + other + "]}", "px", "py", "idx", F.col("py") + 1)
    found = labels_from_geojson(pixels(spark, sf_dir).select(value.alias("value")))
    return found.select("name", "type", _r("lat"), _r("lon"), F.coalesce(F.size("vertices"), F.lit(0)).alias("n_vertices"))


@query
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7."""
    rows = pixels(spark, sf_dir).select(
        F.col("idx").alias("label_id"), F.when(F.col("idx") % 4 == 0, 'a "b", c').otherwise("plain").alias("name"), F.lit("x").alias("code"), F.lit("point").alias("type"),
        F.col("px").alias("lat"), F.col("py").alias("lon"), (F.col("idx") % 3).alias("match_count"), (F.col("idx") % 2).alias("pixel_count"),
    )
    return texts.csv_lines(rows)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(
        F.col("idx").alias("label_id"), F.concat(F.lit("<l&"), F.col("idx"), F.lit(">")).alias("name"), F.lit("c").alias("code"), F.lit("#0a64ff").alias("color"),
        (F.col("px") * 2).alias("lon"), F.col("py").alias("lat"),
        F.when(F.col("idx") % 2 == 0, F.array(*(F.struct((F.col("px") + x).alias("lon"), (F.col("py") + y).alias("lat")) for x, y in ((0, 0), (1, 0), (0, 1))))).alias("vertices"),
    )


@query
def geojson_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, K8: a feature for each label."""
    return texts.features(_placed(spark, sf_dir))


@query
def kml_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    return texts.placemarks(_placed(spark, sf_dir))


@query
def private_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13."""
    p = pixels(spark, sf_dir)
    manual = p.select(
        F.concat(F.lit("m"), "label").alias("name"), F.when(F.col("idx") % 2 == 0, "k").otherwise("").alias("code"), F.lit("point").alias("type"),
        F.when(F.col("idx") % 3 != 0, F.col("emb")).alias("embedding"), F.when(F.col("idx") % 5 == 0, F.array("emb", "emb")).alias("embeddings"),
    )
    saved = p.select(F.lit("s").alias("name"), F.when(F.col("idx") % 4 == 0, F.col("emb")).alias("embedding"))
    return sink_tables.private_rows(manual, saved).groupBy("name", "code", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("embedding")[0]), 5).alias("total"))


@query
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last share of each owner and viewport, public ones listed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.concat(F.lit("User."), "user_id", F.lit("@x.org")).alias("email"), F.col("event_type").alias("viewport"), F.when(F.col("event_id") % 2 == 0, "public").otherwise("private").alias("format"), F.col("event_id").alias("submitted"))
    return sink_tables.public_shares(rows)


@query
def schema_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as an indented scheme, and the nodes that a search shows."""
    level = F.col("event_id") % 4
    indent = F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("\t"), level.cast("int"))).otherwise(F.repeat(F.lit("    "), level.cast("int")))
    line = F.concat(indent, F.lit("E"), "event_id", F.lit(" "), "event_type")
    lines = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("line_no"), line.alias("value"))
    nodes = with_paths(scheme_from_lines(lines, "user_id"), 3, "user_id")
    return filter_scheme(nodes, "ERR").select("user_id", "node_id", "parent_id", "code", "name")


@query
def point_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of points by class, the last class on top."""
    p = pixels(spark, sf_dir).select("idx", "label")
    colours = labels.colour_index(F.col("label"), p, 7)
    hits = p.join(small(colours), F.col("label") == F.col("value")).where("label > 1").select("idx", F.col("label").alias("ord"), F.col("colour"))
    return labels.coloured(p.select("idx"), hits.unionByName(hits.where("idx % 3 = 0").select("idx", (F.col("ord") + 20).alias("ord"), (F.col("colour") + 100).alias("colour"))))


def names(t: DataFrame) -> DataFrame:
    """Folder, validity, base and variant, red and palette place of rows (email, name, css)."""
    red = F.round(g.css_channel(F.col("css"), 0), 6)
    kept = [x for x in t.columns if x not in ("email", "name", "css")]
    return t.select(
        *kept, tx.email_folder(F.col("email")).alias("folder"), tx.valid_name(F.col("name")).alias("valid"), tx.variant_base(F.col("name")).alias("base"), tx.variant_index(F.col("name")).alias("variant"),
        red.alias("red"), g.palette_index(F.col("name")).alias("palette"),
    )


@query
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder names, valid names, variants, colours, one row per event."""
    i = F.col("event_id")
    email = F.when(i % 11 == 0, "!!").otherwise(F.concat(F.lit(" U"), "user_id", F.lit(".x@"), "event_type", F.lit("-Org.net ")))
    name = F.concat("event_type", F.when(i % 7 == 0, " x").otherwise(""), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("_v"), i % 20)))
    css = F.when(i % 4 == 0, F.concat(F.lit("#"), F.lpad(F.hex(i % 256), 2, "0"), F.lit("8000"))).when(i % 4 == 1, "#abc").when(i % 4 == 2, F.concat(F.lit("rgb("), i % 256, F.lit(", 2, 3)"))).otherwise("red")
    return names(_events(spark, sf_dir).select("event_id", email.alias("email"), name.alias("name"), css.alias("css")))


@query
def client_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    real = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" r"), "user_id"))
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a, f"), "user_id"))
    remote = F.when(F.col("event_id") % 2 == 0, F.lit("peer"))
    return e.groupBy(tx.client_address(real, forwarded, remote).alias("address")).agg(F.count(F.lit(1)).alias("n"))


# Clusters


@query
def cluster_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, medoids and radii."""
    p = pixels(spark, sf_dir)
    found = cluster.shares(cluster.medoids(cluster.assign(p, _centroids(p))))
    return found.select("cluster", "medoid", _r("radius"), "n", "pct")


@query
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster as a label around its medoid."""
    p = pixels(spark, sf_dir)
    return cluster.cluster_labels(cluster.assign(p, _centroids(p))).select("cluster", "medoid", _r("threshold"), "pixel_count")


@query
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1; its start is random by seed, so tests check its properties."""
    return cluster.kmeans(pixels(spark, sf_dir), 8)[0].select("idx", "cluster")


@query
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2; tests check its properties."""
    return cluster.principal_components(pixels(spark, sf_dir), 3)[0].select("idx", *(F.round(F.col("pc")[k], 5).alias(f"pc{k}") for k in range(3)))


@query
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2."""
    return cluster.stride_sample(pixels(spark, sf_dir), 60).select("idx")


@query
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: vectors of three by three pixels, end to end."""
    f = F.aggregate("features", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")), lambda a, x: F.struct((a["s"] + x * (a["i"] % 9)).alias("s"), (a["i"] + 1).alias("i")), lambda a: a["s"])
    return cluster.neighbourhood(pixels(spark, sf_dir)).select("idx", F.size("features").alias("n"), F.round(f, 5).alias("mixed"))


# Evaluation


def _folds(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    return p.where("idx % 5 <> 0"), p.where("idx % 5 = 0")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fit_predict("nn", *_folds(pixels(spark, sf_dir))).select("idx", "label", "prediction")


@query
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 (nn)."""
    return _predicted(spark, sf_dir)


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return evaluate.confusion(_predicted(spark, sf_dir)).select("label", "prediction", "n", _r("row_pct", 4))


@query
def f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: scores of each class."""
    return evaluate.class_scores(_predicted(spark, sf_dir)).select("class", "support", *(_r(x, 4) for x in ("precision", "recall", "f1")))


@query
def f1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7."""
    return evaluate.f1_summary(_predicted(spark, sf_dir)).select(*(_r(x, 4) for x in ("macro_f1", "weighted_f1", "accuracy")))


def _regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _folds(pixels(spark, sf_dir).withColumn("target", F.col("emb")[0] * 10 + F.col("label")))
    return evaluate.fit_predict("nn_reg", train, test, "target")


@query
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 (nn_reg), M16."""
    r = _regressed(spark, sf_dir)
    return evaluate.regression_scores(r).crossJoin(evaluate.plot_range(r)).select(*(_r(x, 4) for x in ("r2", "rmse", "mae", "low", "high")))


@query
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: rows to draw of each class, three ways."""
    sizes = pixels(spark, sf_dir).where("label < 4 or idx % 3 = 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    out = [evaluate.quotas(sizes, 120, m).withColumn("mode", F.lit(m)) for m in ("equal", "sqrt", "proportional")]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("mode", "label", "n", "quota")


@query
def spatial_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, M12."""
    at = pixels(spark, sf_dir).select("idx", GRID.lat(F.col("px"), F.col("py")).alias("lat"), GRID.lon(F.col("px"), F.col("py")).alias("lon"))
    kind = "south double, west double, north double, east double"
    train = spark.createDataFrame([(51.8949, -1.001, 52.001, -0.8951), (51.9549, -0.8551, 52.001, -0.7949)], kind)
    test = spark.createDataFrame([(51.8449, -0.9251, 51.9351, -0.8249)], kind)
    return evaluate.spatial_split(at, train, test).select("idx", "split")


@query
def truth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon for every pixel, written to zipped shapefiles and read again; pixels labelled by those over them."""
    p = pixels(spark, sf_dir)
    features = _stars(p).select(
        F.col("polygon").alias("feature_id"), F.transform("vertices", lambda v: F.struct(GRID.lon(v["x"], v["y"]).alias("lon"), GRID.lat(v["x"], v["y"]).alias("lat"))).alias("vertices"),
        F.create_map(F.lit("id"), F.col("polygon").cast("string"), F.lit("class"), (F.col("polygon") % 7).cast("string")).alias("attrs"),
    )
    found = shapes.shapes_in(stored(bundles.shapefile_archives(features, 8)))
    place = F.transform("vertices", lambda v: F.struct(((v["lon"] - GRID.c) / GRID.a).alias("x"), ((v["lat"] - GRID.f) / GRID.e).alias("y")))
    truth = found.select(F.col("attrs")["id"].cast("long").alias("polygon"), F.col("attrs")["class"].cast("int").alias("label"), place.alias("vertices"))
    return labelled_pixels(p, truth).select("idx", "label")


@query
def kfold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: five folds by idx, each predicted by exact neighbours in the others."""
    rows = pixels(spark, sf_dir).select("idx", "emb", "label")
    found = evaluate.cross_validated(rows, "nn", 5, folds=(F.col("idx") % 5).cast("int"))
    return evaluate.f1_summary(found).select(_r("macro_f1", 4), _r("weighted_f1", 4), _r("accuracy", 4))


@query
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, M10."""
    truth = pixels(spark, sf_dir).select(F.when(F.col("idx") % 11 != 0, F.col("label")).alias("label"))
    return evaluate.field_profile(truth, "label")


@query
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, P19."""
    return evaluate.class_counts(pixels(spark, sf_dir), "label")


@query
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained models side by side; tests check their properties."""
    train, test = (x.select("idx", "emb", "label", (F.col("emb")[0] * 10 + F.col("label")).alias("target")) for x in _folds(pixels(spark, sf_dir)))
    out = None
    for name, params in (("nn", {}), ("rf", {"n_estimators": 10, "max_depth": 5}), ("mlp", {"hidden": (16,), "max_iter": 20})):
        row = evaluate.f1_summary(evaluate.fit_predict(name, train, test, **params)).select(F.lit(name).alias("model"), F.col("macro_f1").alias("score"))
        out = row if out is None else out.unionByName(row)
    r = evaluate.regression_scores(evaluate.fit_predict("rf_reg", train, test, "target", n_estimators=10, max_depth=5))
    return out.unionByName(r.select(F.lit("rf_reg").alias("model"), F.col("rmse").alias("score")))


@query
def mlp_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the perceptron regressor's predictions of the held-out fold; rows and targets are held against SQL, tests hold the fit."""
    x = lambda k: F.col("emb")[k]
    planted = (F.abs(x(0)) * 8 + x(1) * x(2) * 40 + F.when(x(3) > 0, 1.0).otherwise(-1.0)).alias("target")
    train, test = (d.select("idx", "emb", planted) for d in _folds(pixels(spark, sf_dir)))
    found = evaluate.fit_predict("mlp_reg", train, test, "target", hidden=(16,), max_iter=15)
    return found.select("idx", _r("target"), (F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("predicted"))


@query
def truth_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of exact neighbours on made-up truth; near chance on random labels, high on clusters."""
    out = None
    for kind in ("random", "clusters"):
        truth = evaluation.synthetic_truth(pixels(spark, sf_dir), 16, kind).select("idx", "emb", "label")
        row = evaluate.f1_summary(evaluate.fit_predict("nn", *_folds(truth))).select(F.lit(kind).alias("kind"), _r("macro_f1", 4), _r("accuracy", 4))
        out = row if out is None else out.unionByName(row)
    return out


@query
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: scores of exact neighbours on growing shares of the training rows."""
    out = None
    for pct, name, scores in evaluate.learning_curve(pixels(spark, sf_dir).select("idx", "emb", "label")):
        row = scores.select(F.lit(pct).alias("pct"), F.lit(name).alias("model"), F.round("macro_f1", 4).alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


# Events and catalog


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, broken ones skipped."""
    line = F.when(F.col("event_id") % 9 == 0, F.concat("props", F.lit("}{"))).when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(
        F.concat(F.lit('{"event":"'), "event_type", F.lit('","pct":'), F.col("event_id") % 4, F.lit("}"))
    )
    found = ev.parse_lines(_events(spark, sf_dir).select(line.alias("value")))
    return found.groupBy("event", "pct").agg(F.count(F.lit(1)).alias("n"))


@query
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per percent, one column per model."""
    e = _events(spark, sf_dir).select(F.lit("progress").alias("event"), F.col("event_type").alias("model"), (F.col("event_id") % 8).alias("pct"), F.col("value").alias("score"))
    return ev.score_table(e, ["click", "view", "error"])


@query
def run_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the text of a run, in chunks that end within lines; points of its models' curves."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", (F.row_number().over(own) - 1).alias("k"))
    models = F.array(*map(F.lit, ("click", "view", "error")))
    kind = lambda name, *more: F.to_json(F.struct(F.lit(name).alias("event"), *more))
    start = kind("start", F.when(F.col("user_id") % 3 == 0, "regression").otherwise("classification").alias("task"), (F.col("user_id") + 1000).alias("total_labelled_pixels"), models.alias("classifiers"))
    score = F.struct(*((F.col("value") / d).alias(x) for x, d in (("mean_f1", 100.0), ("std_f1", 400.0), ("mean_r2", 50.0), ("std_r2", 20.0))))
    scored = kind("progress", (F.col("k") % 10).alias("pct"), (F.col("event_id") % 500).alias("pixel_train_count"), F.create_map(F.col("event_type"), score).alias("classifiers"))
    whole = F.when(F.col("k") % 10 == 0, start).when(F.col("event_type") == "signup", kind("heartbeat")).otherwise(scored)
    line = F.concat(whole, F.when(F.col("event_id") % 17 == 0, "}{").otherwise(""), F.lit("\n"))
    half = F.floor(F.length("line") / 2).cast("int")
    lines = e.select("user_id", "k", line.alias("line")).select("user_id", "k", "line", F.substring("line", F.lit(1), half).alias("a"), F.substring("line", half + 1, F.length("line")).alias("b"))
    # a chunk has the second half of the line before, and the first half of its own
    pieces = lines.select("user_id", F.inline(F.array(F.struct(F.col("k").alias("seq"), F.lit(1).alias("part"), F.col("a").alias("text")), F.struct((F.col("k") + 1).alias("seq"), F.lit(0).alias("part"), F.col("b").alias("text")))))
    chunks = pieces.groupBy("user_id", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"))
    return runs.curve_points(chunks, "user_id", "seq", "text").select("user_id", "model", "pct", *(_r(x) for x in ("x", "mean", "low", "high")))


@query
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each user, with progress in percent."""
    last = ev.latest(_events(spark, sf_dir).select("user_id", "ts", "event_id", "value"), "user_id", "ts")
    return last.select("user_id", "event_id", catalog.progress_percent(F.col("value"), F.lit(20.0)).alias("percent"))


@query
def status_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: where a user's state turns."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("on"))
    return ev.edges(e, "user_id", "ts", "on").select("event_id", "user_id", "on")


@query
def rate_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: attempts in the window before each event."""
    return ev.attempts_in_window(_events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", "ts", 86_400).select("event_id", "attempts")


@query
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: five admitted events a day and user."""
    return ev.rate_limit(_events(spark, sf_dir), "user_id", "ts", "event_id", 5, 86_400).select("event_id", "user_id", "allowed", "retry_after")


@query
def rate_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: attempts with outcomes; an error gives its slot back 90 minutes later, others keep it."""
    tried = _events(spark, sf_dir).withColumn("ended", F.col("ts") + F.expr("interval 90 minutes"))
    log = ev.outcomes(tried, "user_id", "ts", "event_id", "ended", F.col("event_type") == "error")
    return ev.rate_release(log, "user_id", "at", "row", "frees", 3, 86_400).select("user_id", "row", "allowed", "retry_after")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    corner = p.select((F.lit(2018) + F.col("idx") % 7).cast("int").alias("year"), F.col("idx").alias("tile"), (F.col("px") * 0.1).alias("west"), (F.col("py") * 0.1).alias("south"))
    return corner.withColumns({"east": F.col("west") + 0.1, "north": F.col("south") + 0.1})


@query
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, M18."""
    return catalog.coverage(_tiles(spark, sf_dir), 0.35, 0.25, 1.45, 1.35)


@query
def tile_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a removed viewport that no other needs."""
    box = lambda w, s, e, n: (w, s, e, n)
    kind = "box struct<west:double,south:double,east:double,north:double>"
    gone = spark.createDataFrame([(box(0.05, 0.05, 0.95, 0.75),)], kind)
    kept = spark.createDataFrame([(box(0.55, 0.35, 1.55, 1.35),)], kind)
    tiles = _tiles(spark, sf_dir).select("tile", F.struct("west", "south", "east", "north").alias("box"))
    return catalog.unshared_tiles(tiles, gone, kept).select("tile")


@query
def viewport_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewports that a user sees, their years and what is missing."""
    e = _events(spark, sf_dir)
    viewports = e.groupBy(F.col("user_id").alias("viewport_id")).agg(F.max(F.col("event_id") % 3 == 0).alias("x")).select(
        "viewport_id", (F.col("viewport_id") % 2 == 0).alias("private"), F.when(F.col("viewport_id") % 4 == 0, "ann").otherwise("bob").alias("created_by")
    )
    levels = e.select(F.col("user_id").alias("viewport_id"), (F.lit(2018) + F.col("event_id") % 5).cast("int").alias("year"), (F.col("event_id") % 6).cast("int").alias("level"))
    seen = catalog.visible_to(viewports, "ann")
    ready = catalog.readiness(seen, levels.where("viewport_id % 5 <> 0"), levels, [2018, 2019, 2021, 2023])
    short = catalog.missing(ready, [2018, 2019, 2021, 2023])
    years = catalog.years_of(levels)
    text = lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), ",")
    return ready.join(short, "viewport_id").join(years, "viewport_id", "left").select(
        "viewport_id", "has_vectors", "has_pyramids", text("years_available").alias("available"), text("missing_years").alias("missing"), F.coalesce(text("years"), F.lit("")).alias("years")
    )


@query
def storage_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: megabytes of each owner, and whether an estimate fits a quota."""
    e = _events(spark, sf_dir).select("user_id", (F.col("value") * 100_000).cast("long").alias("bytes"))
    return catalog.sizes_mb(e, "user_id").withColumn("fits", catalog.within_quota(F.col("size_mb"), F.lit(40.0), F.lit(100.0)))
