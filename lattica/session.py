"""Session settings for embedding tables of any size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def session(name: str = "lattica", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; the caller's settings win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table, in the shared folder of spark.checkpoint.dir.

    Without that setting a session of one machine gets a temporary folder; on a cluster,
    whose machines would not see it, that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not _one_machine(sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared folder."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, most: int = 10_000, most_bytes: int = 16 << 20) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows and ``most_bytes`` bytes or fewer, else as it is.

    One job both measures and fetches it: the task that holds the first rows stops at
    either bound, so that the driver never gets more. What has been fetched travels with
    the plan (up to 1 MB) and is not computed again; its columns have to be referred to
    by name.
    """
    over = "__over"

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = size = 0
        for batch in batches:
            rows, size = rows + batch.num_rows, size + batch.nbytes
            past = rows > most or size > most_bytes
            kept = batch.slice(0, 1) if past else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([past] * kept.num_rows, pa.bool_())], names=[*kept.schema.names, over])
            if past:
                return

    names = [f"c{k}" for k in range(len(df.columns))]  # two columns may share a name
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, df.schema, strict=True)] + [StructField(over, BooleanType())])
    held = df.toDF(*names).limit(most + 1).repartition(1).mapInArrow(bounded, schema).toArrow()
    if pc.any(held[over]).as_py():
        return df
    held = held.drop_columns([over])
    if held.nbytes > 1 << 20:
        return F.broadcast(df)
    return F.broadcast(df.sparkSession.createDataFrame(held, StructType([StructField(n, f.dataType) for n, f in zip(names, df.schema, strict=True)])).toDF(*df.columns))
