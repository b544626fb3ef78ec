"""Shapefiles as rows: points and polygons with their attributes."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_POINT, _POLYGON = 1, 5


def shapes_of(content: bytes) -> Iterator[tuple[str, list[tuple[float, float]]]]:
    """Type and vertices (x, y; outer ring, not closed) of each record of a .shp file; a null shape has none."""
    at = 100
    while at + 8 <= len(content):
        words = struct.unpack(">i", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == _POINT:
            yield "point", [struct.unpack("<2d", body[4:20])]
        elif kind == _POLYGON:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            ring = list(zip(flat[::2], flat[1::2], strict=True))[: starts[1]]
            yield "polygon", ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        else:
            yield "", []


def attributes_of(content: bytes) -> Iterator[dict[str, str]]:
    """Attributes of each record of a .dbf file, as trimmed text."""
    n, header, width = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    for i in range(n):
        row, pos, out = content[header + i * width : header + (i + 1) * width], 1, {}
        for name, size in fields:
            out[name] = row[pos : pos + size].decode("utf-8", "replace").strip()
            pos += size
        yield out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as files:
                for name in sorted(x for x in files.namelist() if x.lower().endswith(".shp")):
                    table = name[:-4] + ".dbf"
                    shapes = list(shapes_of(files.read(name)))
                    attributes = list(attributes_of(files.read(table))) if table in files.namelist() else [{}] * len(shapes)
                    rows = [
                        {"path": path, "feature_id": i, "type": kind, "vertices": [{"lon": x, "lat": y} for x, y in ring], "attrs": attrs}
                        for i, ((kind, ring), attrs) in enumerate(zip(shapes, attributes, strict=False))
                        if kind
                    ]
                    yield pd.DataFrame(rows, columns=["path", "feature_id", "type", "vertices", "attrs"])


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Features of zipped shapefiles in degrees: feature_id, type, vertices, attrs; each archive is read by one task."""
    return shapes_in(spark.read.format("binaryFile").load(path).select("path", "content"))


def shapes_in(files: DataFrame) -> DataFrame:
    """Features of archives that are rows (path, content)."""
    return files.mapInPandas(_rows, "path string, feature_id long, type string, vertices array<struct<lon:double,lat:double>>, attrs map<string,string>")
