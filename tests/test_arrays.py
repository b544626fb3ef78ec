"""Array files: one file read by several tasks, rows found by number, and round trips."""

import gzip
import io

import numpy as np
import pytest

from lattica.sources import arrays


def _file(path, rows, packed=False):
    out = io.BytesIO()
    np.save(out, rows)
    path.write_bytes(gzip.compress(out.getvalue()) if packed else out.getvalue())


def _rows(df):
    return [r["emb"] for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize("dtype", [np.uint8, np.float32])
@pytest.mark.parametrize("split", [64, 129, 1000, 1 << 20])
def test_one_file_is_read_by_several_tasks(spark, tmp_path, dtype, split):
    rows = np.random.default_rng(1).integers(0, 200, (7, 30, 5)).astype(dtype)
    _file(tmp_path / "a.npy", rows)
    found = arrays.read_vectors(spark, str(tmp_path / "a.npy"), split)
    size = (tmp_path / "a.npy").stat().st_size
    assert found.rdd.getNumPartitions() == -(-size // split)
    assert _rows(found) == rows.reshape(-1, 5).tolist()


def test_small_files_share_a_task_and_packed_ones_are_whole(spark, tmp_path):
    made = {f"{k}.npy{'.gz' * (k % 2)}": np.full((k, 3), k, np.float32) for k in range(6)}
    for name, rows in made.items():
        _file(tmp_path / name, rows, name.endswith("gz"))
    (tmp_path / "notes.txt").write_text("passed over")
    found = arrays.read_vectors(spark, f"file:{tmp_path}")
    assert found.rdd.getNumPartitions() == 1
    got = {}
    for r in found.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["emb"])
    assert got == {name: rows.tolist() for name, rows in made.items() if len(rows)}


def test_only_the_rows_asked_for_are_read(spark, tmp_path):
    rows = np.arange(4000, dtype=np.float32).reshape(1000, 4)
    _file(tmp_path / "a.npy", rows)
    _file(tmp_path / "rows-2000.npy.gz", rows, True)
    whole = np.concatenate([rows, rows]).tolist()
    for first, end, want in ((317, 330, whole[317:330]), (999, 2001, whole[999:1001]), (0, 1, whole[:1]), (1000, 2000, []), (2999, 9999, whole[-1:])):
        assert _rows(arrays.read_vectors(spark, str(tmp_path), 1000, first=first, end=end)) == want
    found = arrays.read_vectors(spark, str(tmp_path), 1000)
    for condition, n in (("idx >= 317 and idx < 330", 13), ("idx = 999 or idx = 3", 2), ("idx = 5", 1), ("true", 2000)):
        assert found.where(condition).count() == n  # one DataFrame, many conditions


def test_only_named_columns_are_read(spark, tmp_path):
    _file(tmp_path / "a.npy", np.ones((5, 2), np.float32))
    found = arrays.read_vectors(spark, str(tmp_path), columns="idx long")
    assert sorted(map(tuple, found.collect())) == [(k,) for k in range(5)]
    with pytest.raises(Exception, match="no columns"):
        arrays.read_vectors(spark, str(tmp_path), columns="idx long, label int").collect()


@pytest.mark.parametrize("change", [lambda x: x[:-3], lambda x: x + b"\0"])
def test_a_cut_file_is_an_error(spark, tmp_path, change):
    _file(tmp_path / "a.npy", np.ones((50, 2), np.float32))
    (tmp_path / "a.npy").write_bytes(change((tmp_path / "a.npy").read_bytes()))
    with pytest.raises(Exception, match="bytes of 400"):
        arrays.read_vectors(spark, str(tmp_path), 100).collect()


def test_written_rows_keep_their_numbers(spark, tmp_path):
    made = [(k, [float(k), k / 4, -1.0]) for k in range(300) if k not in (17, 18, 250)]
    df = spark.createDataFrame(made, "idx long, emb array<double>").repartition(7)
    for _ in range(2):  # the second time in place of the first
        arrays.write_vectors(df, str(tmp_path / "out"), 40)
    found = arrays.read_vectors(spark, str(tmp_path / "out"), 200)
    assert sorted((r["idx"], r["emb"]) for r in found.collect()) == made
    names = sorted(x.name for x in (tmp_path / "out").iterdir())
    assert all(x.startswith("rows-") for x in names) and "rows-000000000000019.npy" in names
    assert np.load(tmp_path / "out" / names[0]).shape[0] <= 40


@pytest.mark.parametrize("rows, words", [
    ([(1, [1.0]), (1, [2.0])], "given twice"),
    ([(1, [1.0]), (2, None)], "missing"),
    ([(1, [1.0, None])], "missing"),
    ([(1, [1.0]), (2, [1.0, 2.0])], "one length"),
    ([(-1, [1.0])], "from 0"),
])
def test_rows_that_no_array_can_hold_are_refused(spark, tmp_path, rows, words):
    df = spark.createDataFrame(rows, "idx long, emb array<double>").coalesce(1)
    with pytest.raises(Exception, match=words):
        arrays.write_vectors(df, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("rows-*"))


def test_an_empty_table_gives_an_empty_folder(spark, tmp_path):
    arrays.write_vectors(spark.createDataFrame([], "idx long, emb array<double>"), str(tmp_path / "out"))
    assert arrays.read_vectors(spark, str(tmp_path / "out")).count() == 0
