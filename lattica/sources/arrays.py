"""Array files (.npy, also gzipped) as a data source of Spark, read by byte ranges and written by rows."""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Element types that vector files may have.
DTYPES = ("|u1", "<f4")
SCHEMA = "path string, idx long, emb array<double>"
#: Bytes of a file that one task reads, and values that it holds at a time.
SPLIT_BYTES = 64 << 20
_VALUES = 1 << 20
_PART = re.compile(r"rows-(\d+)\.npy(\.gz)?$")


def _checked(dtype: np.dtype) -> np.dtype:
    if dtype.str not in DTYPES:
        raise ValueError(f"vectors must be uint8 or little-endian float32, not {dtype.str}")
    return dtype


def load_array(content: bytes) -> np.ndarray:
    """The array of a file's bytes, in row order."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    found = np.load(io.BytesIO(content), allow_pickle=False)
    _checked(found.dtype)
    return np.ascontiguousarray(found)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that all machines know, and the path there."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


@dataclass
class Piece(InputPartition):
    """Byte ranges of files: (path, size, first byte, end); a gzipped file is one range."""

    ranges: list[tuple[str, int, int, int]]


class NpyReader(DataSourceReader):
    """Rows whose first byte lies in a task's ranges, so that no file is opened before the tasks run.

    With the options ``first`` and ``end`` a task goes to the first row wanted and stops
    after the last. They are options and not conditions that Spark pushes: a DataFrame used
    twice kept those of its first use.
    """

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.names, self.schema = schema.names, pa.schema([("path", pa.string()), ("idx", pa.int64()), ("emb", pa.list_(pa.float64()))])
        if unknown := set(self.names) - set(self.schema.names):
            raise ValueError(f"array files have no columns {sorted(unknown)}")
        self.first, self.end = int(options.get("first", 0)), int(options.get("end", 2**63 - 1))

    def partitions(self) -> list[Piece]:
        system, root = located(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith((".npy", ".npy.gz")))
        out, held = [Piece([])], 0
        for path, size in files:
            step = size if path.endswith(".gz") else self.split
            for at in range(0, size, max(1, step)):
                end = min(size, at + step)
                if held and held + end - at > self.split:  # small files share a task
                    out, held = [*out, Piece([])], 0
                out[-1].ranges.append((path, size, at, end))
                held += end - at
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        for path, size, at, end in partition.ranges:
            part = _PART.search(path)
            base = int(part[1]) if part else 0
            for first, rows in self._blocks(system, path, size, at, end, base):
                n, width = rows.shape
                values = pa.array(rows.astype(np.float64).reshape(-1))
                columns = {
                    "path": lambda n=n, path=path: pa.array([path] * n, pa.string()),
                    "idx": lambda n=n, first=first, base=base: pa.array(np.arange(base + first, base + first + n, dtype=np.int64)),
                    "emb": lambda n=n, w=width, values=values: pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * w, w, dtype=np.int32)), values),
                }
                yield pa.RecordBatch.from_arrays([columns[x]() for x in self.names], schema=pa.schema([self.schema.field(x) for x in self.names]))

    def _blocks(self, system: fs.FileSystem, path: str, size: int, at: int, end: int, base: int) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of rows, with the number of their first row in the file."""
        with system.open_input_file(path) as file:
            packed = file.read(2) == b"\x1f\x8b"
            file.seek(0)
            if packed:  # for the task of its first byte
                file = gzip.open(file)
            version = np.lib.format.read_magic(file)
            header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, by_column, dtype = header(file)
            body = file.tell()
            width = shape[-1] if len(shape) else 1
            n = int(np.prod(shape[:-1], dtype=np.int64)) if width else 0
            stride = width * _checked(dtype).itemsize
            if not packed and size != body + n * stride:
                raise ValueError(f"{path} has {size - body} bytes of {n * stride}")
            if not n:
                return
            low, high = (0, n if at == 0 else 0) if packed else (max(0, -(-(at - body) // stride)), min(n, max(0, -(-(end - body) // stride))))
            if by_column:  # such a file's rows are not together: the task of its first row reads it whole
                low, high = (0, n) if low == 0 < high else (0, 0)
            low, high = max(low, self.first - base), min(high, self.end - base)
            if low >= high:
                return
            step = max(1, _VALUES // width)
            if by_column:
                whole = np.frombuffer(file.read(n * stride), dtype).reshape(shape, order="F").reshape(n, width)
                yield from ((k, whole[k : min(k + step, high)]) for k in range(low, high, step))
                return
            file.seek(body + low * stride)
            for k in range(low, high, step):
                m = min(step, high - k)
                data = file.read(m * stride)
                if len(data) != m * stride:
                    raise ValueError(f"{path} ends within its rows")
                yield k, np.frombuffer(data, dtype).reshape(m, width)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written: (first row, end, name)."""

    files: list[tuple[int, int, str]]


class NpyWriter(DataSourceArrowWriter):
    """Rows (idx, emb), in the order of idx within each task, as float32 files named after their first row.

    A file ends at a gap and after ``file_rows`` rows. A task writes to names of its own;
    the files of the tasks that count get their places when all is written, so that a
    task that runs twice does no harm. Missing values, vectors of different lengths and
    a row number given twice are errors.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.most, self.overwrite = options["path"], int(options.get("file_rows", 1 << 16)), overwrite
        self.started = f"_started-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.path)
        system.create_dir(f"{root}/{self.started}")
        files: list[tuple[int, int, str]] = []
        held: list[np.ndarray] = []
        first = end = 0

        def flush() -> None:
            if held:
                rows, name = np.concatenate(held), uuid.uuid4().hex
                with system.open_output_stream(f"{root}/{self.started}/{name}") as out:
                    np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": rows.shape})
                    out.write(rows.tobytes())
                files.append((first, end, name))
                held.clear()

        for batch in iterator:
            idx, emb = batch.column("idx"), batch.column("emb")
            if idx.null_count or emb.null_count or emb.flatten().null_count:
                raise ValueError("rows of array files need idx and a vector without missing values")
            if not batch.num_rows:
                continue
            widths = np.unique(np.asarray(emb.value_lengths()))
            if len(widths) > 1 or (held and held[0].shape[1] != widths[0]):
                raise ValueError("vectors of one array file must be of one length")
            rows = emb.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(emb), widths[0])
            at = idx.to_numpy(zero_copy_only=False).astype(np.int64)
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                if held and at[part[0]] != end:
                    flush()
                while len(part):
                    if not held:
                        first = end = int(at[part[0]])
                    now, part = part[: self.most - (end - first)], part[self.most - (end - first) :]
                    held.append(rows[now])
                    end += len(now)
                    if end - first == self.most:
                        flush()
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        files = sorted(x for m in messages if m for x in m.files)
        for (_, end, _), (first, _, _) in zip(files, files[1:], strict=False):
            if first < end:
                self._clear()
                raise ValueError(f"row {first} is given twice")
        if files and files[0][0] < 0:
            self._clear()
            raise ValueError("rows are numbered from 0")
        system.create_dir(root)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if x.is_file and x.path.endswith((".npy", ".npy.gz")):
                    system.delete_file(x.path)
        for first, _, name in files:
            system.move(f"{root}/{self.started}/{name}", f"{root}/rows-{first:015d}.npy")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = located(self.path)
        if system.get_file_info(f"{root}/{self.started}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.started}")


class Npy(DataSource):
    """``npy``: path, idx and emb of the array files of a folder, or of one file; a given schema names the columns read."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


def read_vectors(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, columns: str = SCHEMA, first: int = 0, end: int = 2**63 - 1
) -> DataFrame:
    """Rows (path, idx, emb) of array files, each read by as many tasks as it has times ``split_bytes``.

    A file of rows that write_vectors has named counts from its first row, any other from
    0. Gzipped files and those stored column by column are read by one task each, the
    former in blocks. Of the files only rows ``first`` to ``end`` (exclusive) are read.
    """
    spark.dataSource.register(Npy)
    options = {"split_bytes": str(split_bytes), "first": str(first), "end": str(end)}
    return spark.read.format("npy").schema(columns).options(**options).load(path)


def write_vectors(vectors: DataFrame, path: str, file_rows: int = 1 << 16) -> None:
    """Vectors (idx, emb) as array files of up to ``file_rows`` rows, in place of those there."""
    vectors.sparkSession.dataSource.register(Npy)
    rows = vectors.select(F.col("idx").cast("long"), F.col("emb").cast("array<float>"))
    ordered = rows.repartitionByRange("idx").sortWithinPartitions("idx")
    ordered.write.format("npy").mode("overwrite").option("file_rows", str(file_rows)).save(path)


def looks_filled(vectors: DataFrame) -> DataFrame:
    """Per file, whether any of its first 1000 values differs from zero."""
    flat = vectors.withColumn("start", F.col("idx") * F.size("emb")).where("start < 1000")
    some = F.exists(F.slice("emb", F.lit(1), F.greatest(F.lit(0), F.least(F.size("emb"), (1000 - F.col("start")).cast("int")))), lambda x: x != 0)
    return flat.groupBy("path").agg(F.max(some).alias("filled"))
