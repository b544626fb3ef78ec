"""Labels as CSV, JSON, GeoJSON and KML, one record per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, kml_colour, xml_text
from ..model import Grid
from ..operators.geom import run_rectangles

CSV_HEADER = "name,code,type,lat,lon,pixel_count"


def csv_lines(labels: DataFrame) -> DataFrame:
    """Records under CSV_HEADER; a count of zero is left empty."""
    count = F.coalesce(F.nullif("match_count", F.lit(0)), F.nullif("pixel_count", F.lit(0)))
    fields = [F.col(x) for x in ("name", "code", "type", "lat", "lon")] + [count]
    return labels.select("label_id", F.concat_ws(",", *map(csv_field, fields)).alias("line"))


def json_envelope(labels: DataFrame, viewport: str, year: int, scheme: str) -> DataFrame:
    """All labels of an export in one JSON document; an export holds one person's labels."""
    rows = F.array_sort(F.collect_list(F.struct(*labels.columns)))
    return labels.agg(F.to_json(F.struct(F.lit(viewport).alias("viewport"), F.lit(year).alias("year"), F.lit(scheme).alias("schema"), rows.alias("labels"))).alias("value"))


def _ring(vertices: Column) -> Column:
    closed = F.concat(vertices, F.slice(vertices, 1, 1))
    return F.transform(closed, lambda v: F.array(v["lon"], v["lat"]))


def features(labels: DataFrame) -> DataFrame:
    """A GeoJSON feature for each label: its polygon with a closed ring, else its point."""
    properties = F.struct("name", "code", "color")
    polygon = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(_ring(F.col("vertices"))).alias("coordinates")).alias("geometry")))
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry")))
    return labels.select("label_id", F.when(F.size("vertices") >= 3, polygon).otherwise(point).alias("feature"))


def run_features(cells: DataFrame, grid: Grid, key: str = "label") -> DataFrame:
    """Runs of pixels as rectangles in degrees: key, west, south, east, north."""
    runs = run_rectangles(cells, key)
    return runs.select(
        key, grid.lon(F.col("x0"), F.col("y0")).alias("west"), grid.lat(F.col("x0"), F.col("y1")).alias("south"), grid.lon(F.col("x1"), F.col("y0")).alias("east"), grid.lat(F.col("x0"), F.col("y0")).alias("north")
    )


def placemarks(labels: DataFrame) -> DataFrame:
    """A KML placemark for each label."""
    place = lambda v: F.concat_ws(",", v["lon"], v["lat"], F.lit(0))
    ring = F.array_join(F.transform(F.concat("vertices", F.slice("vertices", 1, 1)), place), " ")
    polygon = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))
    point = F.concat(F.lit("<Point><coordinates>"), F.concat_ws(",", "lon", "lat", F.lit(0)), F.lit("</coordinates></Point>"))
    colour = F.when(F.length("color") == 7, kml_colour(F.col("color"))).otherwise("ff3388ff")
    style = F.concat(F.lit("<Style><LineStyle><color>"), colour, F.lit("</color></LineStyle></Style>"))
    name = F.concat(F.lit("<name>"), xml_text(F.col("name")), F.lit("</name>"))
    return labels.select("label_id", F.concat(F.lit("<Placemark>"), name, style, F.when(F.size("vertices") >= 3, polygon).otherwise(point), F.lit("</Placemark>")).alias("placemark"))


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON object a line for each row, without its null fields: column value."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    """Event lines added to a folder of text files."""
    event_lines(events).write.mode("append").text(path)
