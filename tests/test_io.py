"""Readers and writers on small files."""

import gzip
import io

import numpy as np
import pytest

from lattica.sinks import bundles, tables, texts
from lattica.sources import arrays, labels, schemes, shapes, viewports
from lattica.sources.tables import VIEWPORT_DEFAULTS, codebook_config, read_pixels, same_bounds


@pytest.mark.parametrize("packed", [False, True])
def test_vectors(spark, tmp_path, packed):
    rows = np.asfortranarray(np.arange(12, dtype=np.float32).reshape(3, 4))
    out = io.BytesIO()
    np.save(out, rows)
    (tmp_path / "v.npy").write_bytes(gzip.compress(out.getvalue()) if packed else out.getvalue())
    found = arrays.read_vectors(spark, str(tmp_path))
    assert [r["emb"] for r in found.orderBy("idx").collect()] == rows.tolist()
    assert found.transform(arrays.looks_filled).first()["filled"]


def test_vectors_of_other_types_are_refused():
    out = io.BytesIO()
    np.save(out, np.zeros(3, np.int64))
    with pytest.raises(ValueError):
        arrays.load_array(out.getvalue())


def test_label_csv(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text(' Name ,LATITUDE,Lng,code\n"a, ""b""\nc",1.5,2,x\n,3,4,\nbad,nan,1,\nworse,abc,1,\n')
    assert sorted(map(tuple, labels.read_labels(spark, str(path)).collect())) == [("Imported", "", 3.0, 4.0), ('a, "b"\nc', "x", 1.5, 2.0)]


def test_label_exports(spark):
    docs = spark.createDataFrame([('{"labels":[{"id":3,"name":"w","lat":1.0,"lon":2.0},{"id":4}]}',), ('[{"id":5,"name":"z"},{"name":"no id"}]',)], "value string")
    got = {r["label_id"]: (r["name"], r["type"], r["threshold"], r["visible"]) for r in labels.labels_from_export(docs).collect()}
    assert got == {3: ("w", "point", 0.0, True), 4: ("Imported", "point", 0.0, True)}
    assert sorted(r["label_id"] for r in labels.saved_labels(docs).collect()) == [3, 5]


def test_shapefiles_round_trip(spark, tmp_path):
    made = bundles.shapefile_zip([([(1.0, 2.0)], {"name": "p", "code": "1"}), ([(0.0, 0.0), (2.0, 0.0), (1.0, 3.0)], {"name": "é"})])
    (tmp_path / "x.zip").write_bytes(made)
    got = sorted((r["type"], [(v["lon"], v["lat"]) for v in r["vertices"]], r["attrs"]["name"]) for r in shapes.read_shapes(spark, str(tmp_path)).collect())
    assert got == [("point", [(1.0, 2.0)], "p"), ("polygon", [(0.0, 0.0), (2.0, 0.0), (1.0, 3.0)], "é")]


def test_bundle():
    meta, body = bundles.unpack_bundle(bundles.pack_bundle({"k": 1}, [np.arange(3, dtype=np.uint8)]))
    assert meta == {"k": 1} and body == b"\0\1\2"


def test_schemes(spark):
    tree = '{"tree":[{"code":"N","name":"Coast","children":[{"code":"N1","name":"Dune"}]},{"code":"T","name":"Forest"}]}'
    nodes = schemes.scheme_from_tree(spark, tree)
    assert [(r["code"], r["depth"], r["parent_id"]) for r in nodes.orderBy("node_id").collect()] == [("N", 0, None), ("N1", 1, 0), ("T", 0, None)]
    assert {r["code"] for r in schemes.filter_scheme(nodes, "dune").collect()} == {"N", "N1"}
    with pytest.raises(ValueError):
        schemes.scheme_from_tree(spark, "{}")


VIEWPORT = "Viewport ID: fen\nLatitude: 52.0°\nLongitude: 0.1°\nMin Latitude: 51.9°\nMax Latitude: 52.1°\nMin Longitude: 0.0°\nMax Longitude: 0.2°\n"


def test_viewports(spark):
    docs = spark.createDataFrame([(VIEWPORT,), (VIEWPORT + "Size: 5km",), ("Viewport ID: x",), (VIEWPORT.replace("51.9", "53"),), (VIEWPORT.replace("Latitude: 52.0", "Latitude: 99", 1),)], "value string")
    got = viewports.parse_viewports(docs).collect()
    assert [r["problem"] for r in got] == [None, None, "fields are missing", "latitudes are not in order", "a latitude is out of range"]
    assert (got[0]["viewport_id"], got[0]["center_lat"], got[0]["size_km"], got[1]["size_km"]) == ("fen", 52.0, 10.0, 5.0)


def test_pixels_are_pruned(spark, tmp_path):
    rows = [("v", y, i, i % 4, i // 4, [float(i)]) for y in (2020, 2021) for i in range(16)]
    df = spark.createDataFrame(rows, "viewport_id string, year int, idx long, px int, py int, emb array<double>")
    path = str(tmp_path / "pixels")
    tables.write_pixels(df, path)
    tables.write_pixels(df.where("year = 2021 and px < 2"), path)  # replaces that year alone
    found = read_pixels(spark, path, "v", [2020], (1, 1, 3, 3))
    assert sorted(r["idx"] for r in found.collect()) == [5, 6, 9, 10]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan and "PushedFilters: [IsNotNull(px)" in plan
    assert spark.read.parquet(path).count() == 24


def test_settings():
    assert codebook_config(None) == {"tile": 512, "k": 20, "k2": 256, "metric": "L2"}
    assert codebook_config({"metric": "cosine", "k2": 5})["k2"] is None
    assert codebook_config({"k": "9"}, VIEWPORT_DEFAULTS) == {"tile": 64, "k": 9, "k2": None, "metric": "L2"}
    with pytest.raises(ValueError):
        codebook_config({"k": 0})


def test_same_bounds(spark):
    m = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.001)], "id int, west double, south double, east double, north double")
    assert [r["id"] for r in same_bounds(m, 0.00005, 0, 1, 1).collect()] == [1]


def test_envelope(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "label_id int, name string")
    assert texts.json_envelope(df, "v", 2024, "s").first()[0] == '{"viewport":"v","year":2024,"schema":"s","labels":[{"label_id":1,"name":"a"},{"label_id":2,"name":"b"}]}'
