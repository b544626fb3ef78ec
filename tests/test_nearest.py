"""Nearest rows of blocks of vectors: what single precision leaves out, and what a task holds."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.operators import search


@pytest.mark.parametrize("scale", [1.0, 1e20, 1e-25])
@pytest.mark.parametrize("kind", ["spread", "grid", "same", "shifted"])
def test_blocks_one_by_one_as_brute_force(kind, scale):
    r = np.random.default_rng(3)
    a, b, ids = r.normal(size=(1500, 8)), r.normal(size=(40, 8)), r.permutation(1500)
    if kind == "grid":
        a, b = np.round(a), np.round(b)
    if kind == "same":
        a[:], b[:] = 1, 1
    if kind == "shifted":  # single precision sees nothing of the differences
        a, b = a + 1e6, b + 1e6
    a, b, k = a * scale, b * scale, 5
    held = search._nobody(len(b), k)
    for part in (slice(0, 3), slice(3, 700), slice(700, 1500)):
        held = search._nearest(a[part], ids[part], ids[part] * 2.0, b, held)
    d2 = ((a[None] - b[:, None]) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :k]
    assert (held[0] == np.take_along_axis(d2, order, 1)).all() and (held[1] == ids[order]).all() and (held[2] == ids[order] * 2.0).all()


def _pairs(n_left, n_right, size=1024, dims=64):
    r = np.random.default_rng(4)
    vectors = lambda: r.normal(size=size * dims)
    right = [(k, np.arange(size) + k * size, vectors()) for k in range(n_right)]
    for k in range(n_left):
        rows, v = vectors(), np.zeros(size)
        for b, q, qv in right:
            lists = [pa.array([x]) for x in (np.arange(size) + k * size, v, rows)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([b]), pa.array([q]), pa.array([qv])], names=["idx", "v", "rv", "b", "q", "qv"])


def test_a_task_emits_a_row_a_block_and_holds_little():
    """Of 4 blocks of rows by 2 of queries: two rows come out, and no matrix of all pairs in double precision is made."""
    batches = list(_pairs(4, 2))
    tracemalloc.start()
    found = list(search._keep_nearest(5)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(x.column("b")[0].as_py() for x in found) == [0, 1] and all(x.num_rows == 1 for x in found)
    assert peak < 20 << 20


def test_copies_of_one_vector_are_merged_in_portions():
    """All 4096 x 1024 pairs are as near: no array of all of them is made, and the smallest ids are found."""
    r = np.random.default_rng(5)
    a, b, ids = np.ones((4096, 16)), np.ones((1024, 16)), r.permutation(4096)
    tracemalloc.start()
    held = search._nearest(a, ids, ids * 2.0, b, search._nobody(len(b), 5))
    held = search._nearest(a, ids - 4096, ids * 3.0, b, held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (held[0] == 0).all() and (held[1] == np.arange(-4096, -4091)).all() and (held[2] == np.arange(5) * 3.0).all()
    assert peak < 96 << 20


def test_portions_give_the_same_neighbours(monkeypatch):
    r = np.random.default_rng(6)
    a, b, ids = np.round(r.normal(size=(900, 3))), np.round(r.normal(size=(50, 3))), r.permutation(900)
    whole = search._nearest(a, ids, ids * 2.0, b, search._nobody(len(b), 7))
    monkeypatch.setattr(search, "_TILE", 64)
    monkeypatch.setattr(search, "_MERGED", 100)
    held = search._nearest(a, ids, ids * 2.0, b, search._nobody(len(b), 7))
    d2 = ((a[None] - b[:, None]) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :7]
    for x, y, z in zip(held, whole, (np.take_along_axis(d2, order, 1), ids[order], ids[order] * 2.0), strict=True):
        assert (x == y).all() and (x == z).all()


def test_batches_for_python_stay_small(spark, monkeypatch, tmp_path):
    """One block of rows by 20 of queries, of 1 MB each: they come to Python in batches of BATCH_BYTES and a row at most."""
    inner, sizes = search._keep_nearest, tmp_path / "sizes"

    def noted(k):
        run = inner(k)

        def each(batches):
            for batch in batches:
                with sizes.open("a") as f:
                    f.write(f"{batch.nbytes}\n")
                yield batch

        return lambda batches: run(each(batches))

    monkeypatch.setattr(search, "_keep_nearest", noted)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 30))
    try:
        emb = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: (F.col("id") * x % 97).cast("double"))
        vectors = lambda n: spark.range(n).select(F.col("id").alias("idx"), emb.alias("emb"))
        assert search.nearest_rows(vectors(1000), vectors(20_000), 2).count() == 40_000
    finally:
        spark.conf.set(name, before)
    seen = [int(x) for x in sizes.read_text().split()]
    assert len(seen) > 1 and max(seen) < search.BATCH_BYTES + (3 << 20)
