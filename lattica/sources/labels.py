"""Label files: CSV, GeoJSON, label exports and saved labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_name

#: Names of columns that a label file may use.
LAT, LON, NAME = ("lat", "latitude", "y"), ("lon", "lng", "long", "longitude", "x"), ("name", "label")

_POINTS = "struct<type:string,coordinates:string>"
_FEATURES = f"array<struct<geometry:{_POINTS},properties:struct<name:string,label:string,code:string,color:string>>>"
_LABEL = (
    "struct<id:long,name:string,color:string,code:string,type:string,lat:double,lon:double,embedding:array<double>,threshold:double,"
    "visible:boolean,matchCount:long,vertices:array<struct<lat:double,lon:double>>,pixelCount:long>"
)


def _column(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns, by a trimmed header in lower case."""
    known = {x.strip().lower(): x for x in df.columns}
    for name in names:
        if name in known:
            return F.col(f"`{known[name]}`")
    return F.lit(None).cast("string")


def labels_from_table(rows: DataFrame) -> DataFrame:
    """Point labels (name, code, lat, lon) of rows of text, those without finite coordinates left out."""
    number = lambda names: F.trim(_column(rows, names)).try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    name, code = F.trim(_column(rows, NAME)), F.trim(_column(rows, ("code",)))
    found = rows.select(
        F.coalesce(F.nullif(name, F.lit("")), F.lit("Imported")).alias("name"), F.coalesce(code, F.lit("")).alias("code"), number(LAT).alias("lat"), number(LON).alias("lon")
    )
    return found.where(finite(F.col("lat")) & finite(F.col("lon")))


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """One point label per row of a CSV file; fields may be quoted and hold line ends."""
    return labels_from_table(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE"))


def labels_from_geojson(documents: DataFrame) -> DataFrame:
    """Labels (name, code, type, lat, lon, vertices) of texts ``value``: points, and outer rings of polygons; others are passed over."""
    features = documents.select(F.explode(F.from_json("value", f"struct<features:{_FEATURES}>")["features"]).alias("f"))
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.from_json(coordinates, "array<double>")
    ring = F.from_json(coordinates, "array<array<array<double>>>")[0]
    vertices = F.transform(ring, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    closed = F.when((F.size(vertices) > 1) & (F.element_at(vertices, 1) == F.element_at(vertices, -1)), F.slice(vertices, F.lit(1), F.size(vertices) - 1)).otherwise(vertices)
    mean = lambda k: F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v[k]) / F.size("vertices")
    named = features.select(
        label_name(F.col("f.properties.name"), F.col("f.properties.label")).alias("name"),
        F.coalesce("f.properties.code", F.lit("")).alias("code"),
        F.lower(kind).alias("type"),
        F.when(kind == "Point", point).alias("at"),
        F.when(kind == "Polygon", closed).alias("vertices"),
    ).where("type in ('point', 'polygon')")
    return named.select(
        "name", "code", "type", F.coalesce(F.col("at")[1], mean("lat")).alias("lat"), F.coalesce(F.col("at")[0], mean("lon")).alias("lon"), "vertices"
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return labels_from_geojson(spark.read.text(path, wholetext=True))


def labels_from_export(documents: DataFrame) -> DataFrame:
    """Labels of an export envelope; what a label lacks gets its default."""
    rows = documents.select(F.explode(F.from_json("value", f"struct<labels:array<{_LABEL}>>")["labels"]).alias("l")).select("l.*")
    filled = {"color": "#3388ff", "code": "", "type": "point", "threshold": 0.0, "visible": True, "matchCount": 0, "pixelCount": 0, "name": "Imported"}
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in filled.items()}).withColumnRenamed("id", "label_id")


def saved_labels(documents: DataFrame) -> DataFrame:
    """Saved labels of an envelope or a bare array; those without id or name are skipped."""
    kind = f"array<{_LABEL}>"
    rows = F.coalesce(F.from_json("value", f"struct<labels:{kind}>")["labels"], F.from_json("value", kind))
    return documents.select(F.explode(rows).alias("l")).select("l.*").where("id is not null and name is not null").withColumnRenamed("id", "label_id")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a file by its ending."""
    ending = path.lower().rsplit(".", 1)[-1]
    if ending == "csv":
        return read_label_csv(spark, path)
    if ending == "geojson":
        return read_geojson(spark, path)
    if ending == "json":
        return labels_from_export(spark.read.text(path, wholetext=True))
    if ending in ("zip", "shp"):
        from .shapes import read_shapes

        return read_shapes(spark, path)
    raise ValueError(f"labels cannot be read from .{ending}")
