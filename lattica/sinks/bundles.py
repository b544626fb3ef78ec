"""Binary files of bounded size: array bundles and shapefiles of one export."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_bundle(meta: dict, arrays: list[np.ndarray]) -> bytes:
    """Length of the header in four bytes, high one first, the header as JSON, and the arrays' bytes."""
    header = json.dumps(meta).encode()
    return struct.pack(">I", len(header)) + header + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)


def unpack_bundle(content: bytes) -> tuple[dict, bytes]:
    n = struct.unpack(">I", content[:4])[0]
    return json.loads(content[4 : 4 + n]), content[4 + n :]


def _shape_file(records: list[bytes], kind: int, box: tuple[float, float, float, float]) -> tuple[bytes, bytes]:
    """Contents of .shp and .shx."""

    def header(words: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)

    body, index, at = b"", b"", 50
    for i, record in enumerate(records, 1):
        words = len(record) // 2
        body += struct.pack(">2i", i, words) + record
        index += struct.pack(">2i", at, words)
        at += 4 + words
    return header(at) + body, header(50 + 4 * len(records)) + index


def shapefile_archives(features: DataFrame, archives: int) -> DataFrame:
    """Features (feature_id, vertices of lon and lat, attrs) as zipped shapefiles (path, content), dealt out by their id.

    A task holds one archive at a time: choose ``archives`` so that one of them is small.
    """

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = [([(v["lon"], v["lat"]) for v in r.vertices], dict(r.attrs)) for r in rows.sort_values("feature_id").itertuples()]
        return pd.DataFrame({"path": [f"shapes-{key[0]}.zip"], "content": [shapefile_zip(held)]})

    dealt = features.withColumn("archive", F.pmod(F.col("feature_id"), F.lit(archives)))
    return dealt.groupBy("archive").applyInPandas(make, "path string, content binary")


def shapefile_zip(features: list[tuple[list[tuple[float, float]], dict[str, str]]]) -> bytes:
    """Points (one vertex) and polygons with text attributes as zipped shapefiles, one for each type there is."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as files:
        for name, kind, mine in (("points", 1, [f for f in features if len(f[0]) == 1]), ("polygons", 5, [f for f in features if len(f[0]) > 2])):
            if not mine:
                continue
            flat = [p for ring, _ in mine for p in ring]
            box = (min(x for x, _ in flat), min(y for _, y in flat), max(x for x, _ in flat), max(y for _, y in flat))
            records = []
            for ring, _ in mine:
                if kind == 1:
                    records.append(struct.pack("<i2d", 1, *ring[0]))
                else:
                    closed = [*ring, ring[0]]
                    xs, ys = [x for x, _ in closed], [y for _, y in closed]
                    records.append(struct.pack("<i4d3i", 5, min(xs), min(ys), max(xs), max(ys), 1, len(closed), 0) + b"".join(struct.pack("<2d", *p) for p in closed))
            shp, shx = _shape_file(records, kind, box)
            fields = sorted({k for _, attrs in mine for k in attrs})
            rows = b"".join(b" " + b"".join((attrs.get(k) or "").encode()[:80].ljust(80) for k in fields) for _, attrs in mine)
            columns = b"".join(k.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([80, 0]) + bytes(14) for k in fields)
            table = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(mine), 33 + 32 * len(fields), 1 + 80 * len(fields)) + columns + b"\r" + rows + b"\x1a"
            for ending, content in ((".shp", shp), (".shx", shx), (".dbf", table)):
                files.writestr(name + ending, content)
    return out.getvalue()
