"""Shared pieces: checkpoints, Arrow batches of text, and numpy text kernels.

The kernels work on a whole batch of documents at once: the UTF-8 bytes of
all texts lie in one array, ``offsets`` says where each text begins.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a kernel looks at in one go; a longer text is a batch of its own.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch sent to Python.
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where the session names none, one machine gets a folder of its own, as in tests; on a
    cluster, whose machines would not see it, that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read from there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    done = df.checkpoint()
    tidy(df.sparkSession)
    return done


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files that no DataFrame leads to any more.

    The cleaner acts on what the driver's collectors have found to be garbage, and a
    driver that does little may not collect for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class KeyFilter:
    """A bit for each of many 64-bit hashes; tells surely which ones are not among them.

    It has 16 MB at most: with more keys it passes more, and an exact join follows.
    """

    MOST_BITS = 1 << 27

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        self.bits = 1 << min(self.MOST_BITS.bit_length() - 1, max(16, (16 * n).bit_length()))
        bit = F.col(key).bitwiseAND(self.bits - 1).alias("bit")
        words = keys.select(bit).selectExpr("shiftright(bit, 6) as word", "shiftleft(1L, cast(bit & 63 as int)) as flags")
        found = words.groupBy("word").agg(F.bit_or("flags").alias("flags")).toArrow()  # two numbers a word, no Row objects
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[found["word"].to_numpy()] = found["flags"].to_numpy()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        bit = (keys.view(np.uint64) & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.words[bit >> 6] >> (bit & 63)) & 1 == 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of ``df`` has it."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches small enough for texts of any usual length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of about CHUNK_BYTES of text, with their bytes and offsets."""
    data, offsets = utf8(batch.column(column))
    n, start = batch.num_rows, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, start + 1))
        at = offsets[start : end + 1]
        yield batch.slice(start, end - start), data[at[0] : at[-1]], at - at[0]
        start = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Hasher:
    """64-bit hashes of any substrings of ``data``, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(x + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags, broken at text bounds."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(flags) + 1, bool)
    before[0], before[1:] = False, flags
    after = np.empty(len(flags) + 1, bool)
    after[-1], after[:-1] = False, flags
    inner = offsets[1:-1]
    starts, ends = after & ~before, before & ~after
    cut = inner[before[inner] & after[inner]]
    starts[cut] = True
    ends[cut] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def first_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each text's first span, and at last the number of spans."""
    return np.searchsorted(starts, offsets)


def owner(first: np.ndarray) -> np.ndarray:
    """Number of the text of each span."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's spans."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words, and the index of each text's first window.

    Hash i of the result begins at word ``i + (k - 1) * texts before it that have
    k words or more, or all of their words for shorter ones``; use window_words().
    """
    at = window_words(first, k)
    x = np.zeros(len(at), np.uint64)
    for j in range(k):
        x = (x + words[at + j]) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(29)
    return mix(x), np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - k + 1, 0))])


def window_words(first: np.ndarray, k: int) -> np.ndarray:
    """The words at which a window of k words of one text begins."""
    n = first[-1]
    ok = np.ones(n, bool)
    for j in range(1, k):
        late = first[1:] - j
        ok[late[late >= first[:-1]]] = False
    return np.flatnonzero(ok)
