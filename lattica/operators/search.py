"""Point lookup and similarity search over pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.vec import l2sq, once
from ..model import Grid
from ..session import small

#: The clicked pixel, then its neighbours in the order in which they are tried.
NEIGHBOURS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))
#: Query vectors packed in one row for distances in the JVM.
BLOCK = 256
#: Blocks of queries sent to every task at once.
SENT = 64
#: Bytes after which a batch of blocks is closed on its way to Python; Spark's default is 64 MB.
BATCH_BYTES = 8 << 20


def extract(pixels: DataFrame, probes: DataFrame, grid: Grid) -> DataFrame:
    """The pixel under each probe (probe, lat, lon), else its first neighbour that exists."""
    ring = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for k, (x, y) in enumerate(NEIGHBOURS)))
    tried = probes.select("probe", grid.column(F.col("lon")).alias("cx"), grid.row(F.col("lat")).alias("cy"), F.inline(ring))
    tried = tried.select("probe", "ord", (F.col("cx") + F.col("dx")).alias("px"), (F.col("cy") + F.col("dy")).alias("py"))
    hits = pixels.join(small(tried, 100_000), ["px", "py"])
    return hits.groupBy("probe").agg(F.min_by(F.struct("idx", "px", "py", "emb"), "ord").alias("p")).select("probe", "p.*")


def range_search(pixels: DataFrame, query: Column, threshold: float, grid: Grid) -> DataFrame:
    """Pixels within a distance of a vector, the threshold included, with places and distances."""
    near = pixels.select("idx", "px", "py", once(l2sq("emb", query)).alias("d2")).where(F.col("d2") <= threshold * threshold)
    return near.select("idx", "px", "py", grid.lat(F.col("px"), F.col("py")).alias("lat"), grid.lon(F.col("px"), F.col("py")).alias("lon"), F.sqrt("d2").alias("distance"))


def packed_blocks(queries: DataFrame, kept: tuple[str, ...] = ("emb", "t2")) -> tuple[DataFrame, int]:
    """Query vectors (emb, and t2 if there) in rows of about BLOCK, and how many rows these are at most.

    One job tells whether one block holds all, and fetches it; SENT blocks are sent to every task.
    """
    fields = [x for x in kept if x in queries.columns]
    few = queries.select(fields)
    first = few.limit(BLOCK + 1).collect()
    if len(first) <= BLOCK:
        one = StructType([StructField("block", LongType()), StructField("queries", ArrayType(few.schema))])
        return F.broadcast(queries.sparkSession.createDataFrame([(0, first)] if first else [], one)), 1
    n = -(-queries.count() // BLOCK)
    dealt = queries.select(F.pmod(F.xxhash64(*queries.columns), F.lit(n)).alias("block"), *fields)
    blocks = dealt.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("queries"))
    return F.broadcast(blocks) if n <= SENT else blocks, n


def nearest_rows(rows: DataFrame, queries: DataFrame, k: int, value: str | None = None, block: int = 1024, sent: int = SENT) -> DataFrame:
    """The k nearest rows (idx, emb) of each query (idx, emb) by distance, then idx: source, idx, d2, and a value of the row.

    Rows and queries whose vector is null or empty, or holds a null or NaN, are passed over.
    Blocks of rows meet blocks of queries, as two matrices in an Arrow batch; a task keeps
    k rows for each query it has seen, and only these are shuffled, as one row for a block
    of queries, merged and ranked. ``sent`` blocks of queries are broadcast at once; more of
    them are as many passes over the rows' blocks, which two tasks a core share out. What a
    task holds does not grow with the rows: a batch, k rows for each query sent, and tiles of
    a product; to that end the session's Arrow batches are cut at BATCH_BYTES from here on.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    named = F.col(value).cast("double") if value else F.lit(0.0)
    # a vector that is not there, or has a gap, is near nothing
    whole = F.col("emb").isNotNull() & (F.size("emb") > 0) & ~F.exists("emb", lambda x: x.isNull() | F.isnan(x))
    rows, queries = rows.where(whole), queries.where(whole)
    n_queries, n_rows = queries.count(), rows.count()
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    left_block = min(4 * block, max(block, n_rows // (2 * tasks)))  # longer ones are sent and merged less often
    n_left, n_blocks = max(1, -(-n_rows // left_block)), max(1, -(-n_queries // block))
    deal = lambda df, n, *more: df.select(F.pmod(F.xxhash64("idx"), F.lit(n)).alias("block"), "idx", "emb", *more)
    left = deal(rows, n_left, named.alias("v")).groupBy("block").agg(F.collect_list(F.struct("idx", "v")).alias("r"), F.flatten(F.collect_list("emb")).alias("rv"))
    right = deal(queries, n_blocks).groupBy("block").agg(F.collect_list("idx").alias("q"), F.flatten(F.collect_list("emb")).alias("qv"))
    left = left.repartitionById(min(tasks, n_left), (F.col("block") % min(tasks, n_left)).cast("int")).select("r.idx", "r.v", "rv")
    right = right.select(F.col("block").alias("b"), "q", "qv")
    kept = None
    for at in range(0, n_blocks, sent):
        part = right if n_blocks <= sent else right.where(F.col("b").between(at, at + sent - 1))
        found = left.crossJoin(F.broadcast(part)).mapInArrow(_keep_nearest(k), "b long, q array<long>, d2 array<double>, idx array<long>, v array<double>")
        kept = found if kept is None else kept.unionByName(found)
    best = kept.groupBy("b").applyInArrow(_merge_nearest(k), "source long, idx long, v double, d2 double")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("d2", "idx"))
    out = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("source", "rank", "idx", "d2", *([F.col("v").alias(value)] if value else []))


#: Fixed value: the id beside a distance of NaN where fewer than k rows have been seen.
_NONE = np.iinfo(np.int64).max
#: Rows of the first matrix that set a bound or are multiplied at once, pairs whose distances are, and pairs kept before they are merged.
_FIRST, _TILE, _PAIRS, _MERGED = 1024, 512, 16_384, 131_072

Held = tuple[np.ndarray, np.ndarray, np.ndarray]


def _keep_nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Held]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, v, q = (batch.column(x)[i].values.to_numpy(zero_copy_only=False) for x in ("idx", "v", "q"))
                if not len(ids) or not len(q):
                    continue
                a = batch.column("rv")[i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                b = batch.column("qv")[i].values.to_numpy(zero_copy_only=False).reshape(len(q), -1)
                at = batch.column("b")[i].as_py()
                before = held[at][1] if at in held else _nobody(len(q), k)
                held[at] = (held[at][0] if at in held else q.copy(), _nearest(a, ids, v, b, before))
            batch = ids = v = q = a = b = None  # the next batch comes in place of this one
        for at, (q, found) in held.items():
            lists = [pa.array([x.ravel()]) for x in (q, *found)]
            yield pa.RecordBatch.from_arrays([pa.array([at]), *lists], names=["b", "q", "d2", "idx", "v"])

    return run


def _merge_nearest(k: int):
    def run(table: pa.Table) -> pa.Table:
        """The k nearest of a block of queries, of what each task has found for it."""
        parts = [[table.column(x)[i].values.to_numpy(zero_copy_only=False) for x in ("q", "d2", "idx", "v")] for i in range(table.num_rows)]
        orders = [np.argsort(p[0], kind="stable") for p in parts]
        d2, ids, v = (np.concatenate([p[c].reshape(-1, k)[o] for p, o in zip(parts, orders, strict=True)], axis=1) for c in (1, 2, 3))
        order = np.lexsort((ids, d2), axis=1)[:, :k]
        d2, ids, v = (np.take_along_axis(x, order, 1).ravel() for x in (d2, ids, v))
        there = ~(np.isnan(d2) & (ids == _NONE))
        columns = {"source": np.repeat(parts[0][0][orders[0]], k), "idx": ids, "v": v, "d2": d2}
        return pa.table({name: x[there] for name, x in columns.items()})

    return run


def _nobody(n: int, k: int) -> Held:
    return np.full((n, k), np.nan), np.full((n, k), _NONE), np.zeros((n, k))


def _nearest(a: np.ndarray, ids: np.ndarray, v: np.ndarray, b: np.ndarray, held: Held) -> Held:
    """Distances, ids and values of the k nearest rows to each row of ``b``: those held so far, and those of ``a``.

    One product of matrices in single precision, whose error is bounded, leaves out pairs
    that are farther apart than the last one held; distances of the others are exact.
    """
    at = 0
    while at < len(a):
        new = np.isnan(held[0][:, -1]).any()
        end = min(len(a), at + _FIRST) if new else len(a)
        held = _nearer(a[at:end], ids[at:end], v[at:end], b, held)
        at = end
    return held


def _nearer(a: np.ndarray, ids: np.ndarray, v: np.ndarray, b: np.ndarray, held: Held) -> Held:
    k = held[0].shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
        kind = np.float32 if max(a2.max(), b2.max()) < 1e30 else np.float64
        error = 4 * (a.shape[1] + 8) * np.finfo(kind).eps
        bound = np.where(np.isnan(held[0][:, -1]), np.inf, held[0][:, -1])
        columns = np.column_stack([a, a2, np.ones(len(a))]).astype(kind)
        less = lambda by: np.column_stack([-2 * b, np.ones(len(b)), b2 - by]).astype(kind)
        limit = bound + error * (a2.max() + b2 + bound) + 1e-37
        open_ = ~np.isfinite(limit)
        if open_.any() and len(a) > k:  # nothing to go by yet: the k nearest of these rows bound the rest
            rough = np.partition(less(0 * b2) @ columns.T, k - 1, axis=1)[:, k - 1].astype(np.float64)
            limit = np.where(open_, rough + 2 * error * (a2.max() + b2 + np.abs(rough)) + 1e-37, limit)
        limit = np.where(np.isfinite(limit), limit, np.inf)
        beyond, near, n = less(limit), [], 0
        beyond[~np.isfinite(limit)] = np.nan  # whatever can't be told is near
        for at in range(0, len(a), _TILE):
            far = beyond @ columns[at : at + _TILE].T > 0
            row, column = np.divmod(np.flatnonzero(np.logical_not(far, out=far)), far.shape[1])
            near.append((row, column + at))
            n += len(row)
            if n > _MERGED or at + _TILE >= len(a):  # of many copies of a vector all are near
                _merge_pairs(a, ids, v, b, held, *map(np.concatenate, zip(*near, strict=True)))
                near, n = [], 0
    return held


def _merge_pairs(a: np.ndarray, ids: np.ndarray, v: np.ndarray, b: np.ndarray, held: Held, i: np.ndarray, j: np.ndarray) -> None:
    """The pairs of rows ``i`` of ``b`` and ``j`` of ``a`` merged into what is held."""
    d2 = np.empty(len(i))
    for at in range(0, len(i), _PAIRS):
        part = slice(at, at + _PAIRS)
        d2[part] = ((a[j[part]] - b[i[part]]) ** 2).sum(1)
    last = held[0][i, -1]
    kept = ~((d2 > last) | ((d2 == last) & (ids[j] > held[1][i, -1])))
    i, j, d2 = i[kept], j[kept], d2[kept]
    if not len(i):
        return
    k = held[0].shape[1]
    n = np.bincount(i, minlength=len(b))
    some = np.flatnonzero(n)
    flat = [np.concatenate([old[some].ravel(), new]) for old, new in zip(held, (d2, ids[j], v[j]), strict=True)]
    order = np.lexsort((flat[1], flat[0], np.concatenate([np.repeat(some, k), i])))
    ends = np.cumsum(n[some] + k)
    first = order[(ends - n[some] - k)[:, None] + np.arange(k)]
    for old, both in zip(held, flat, strict=True):
        old[some] = both[first]


def min_sq_distances(pixels: DataFrame, queries: DataFrame) -> DataFrame:
    """Least squared distance of each pixel to the query vectors; nothing without queries."""
    blocks, n = packed_blocks(queries)
    d2 = F.array_min(F.transform("queries", lambda q: l2sq(F.col("emb"), q["emb"])))
    each = pixels.crossJoin(blocks).select("idx", "px", "py", once(d2).alias("d2"))
    return each if n == 1 else each.groupBy("idx", "px", "py").agg(F.min("d2").alias("d2"))


def matches(distances: DataFrame, threshold: float | Column) -> DataFrame:
    """min_sq_distances() cut at a threshold, or at one of each row."""
    return distances.where(F.col("d2") <= threshold * threshold)


def multi_search(pixels: DataFrame, queries: DataFrame) -> DataFrame:
    """Pixels near any query (emb, t2: squared threshold of its own), once each, at distance 0."""
    near = F.exists("queries", lambda q: l2sq(F.col("emb"), q["emb"]) <= q["t2"])
    blocks, n = packed_blocks(queries)
    hits = pixels.crossJoin(blocks).where(near).select("idx", "px", "py")
    return (hits if n == 1 else hits.distinct()).withColumn("distance", F.lit(0.0))


def match_stats(found: DataFrame, total: int) -> DataFrame:
    """Count, share in percent, and extent of distances; null extents where nothing matches."""
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) / F.lit(float(total)) * 100).alias("pct"),
        F.min("distance").alias("min_distance"),
        F.max("distance").alias("max_distance"),
        F.avg("distance").alias("mean_distance"),
    )


def nearest(pixels: DataFrame, query: Column, k: int) -> DataFrame:
    """The k nearest pixels to a vector, ties by idx."""
    return pixels.select("idx", l2sq("emb", query).alias("d2")).orderBy("d2", "idx").limit(k)


def nearest_place(points: DataFrame, lat: float, lon: float, within: float | None = None) -> DataFrame:
    """The point (idx, lat, lon) nearest to a place in degrees, if nearer than ``within``."""
    d2 = (F.col("lat") - lat) * (F.col("lat") - lat) + (F.col("lon") - lon) * (F.col("lon") - lon)
    best = points.select("idx", d2.alias("d2")).agg(F.min_by("idx", F.struct("d2", "idx")).alias("idx"), F.min("d2").alias("d2"))
    return best.where("idx is not null" if within is None else f"sqrt(d2) < {within}")


def inside(points: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return points.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
