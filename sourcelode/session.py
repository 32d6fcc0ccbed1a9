"""Session settings, the shared scratch folder and measured broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 * 1024 * 1024
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "sourcelode", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is sent at once by ``BATCH_BYTES``, unless the session names a bound of its own."""
    if spark.conf.get(BATCHES, None) is None:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster that names none is an error,
    because a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sourcelode-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"



class _Scratch(threading.local):
    """Folders of a thread's running ``scratch`` blocks, innermost last."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_scratch = _Scratch()


def checkpoint(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later uses neither recompute it nor depend on an executor, and read only the columns they need.
    Inside a ``scratch`` block the folder goes when the block ends.
    """
    path = fresh_path(df.sparkSession, label)
    if _scratch.blocks:
        _scratch.blocks[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``checkpoint`` writes inside the block, once it ends; nothing lazy may outlive it."""
    _scratch.blocks.append([])
    try:
        yield
    finally:
        for path in _scratch.blocks.pop():
            delete_folder(spark, path)


def _storage(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever storage its path names; a missing one is no error."""
    folder, storage = _storage(spark, path)
    storage.delete(folder, True)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``."""
    folder, storage = _storage(spark, path)
    return [entry.getPath().getName() for entry in storage.listStatus(folder) if entry.isDirectory()]


@contextmanager
def lasting() -> Iterator[None]:
    """Checkpoints inside the block outlive the ``scratch`` blocks around it."""
    held, _scratch.blocks = _scratch.blocks, []
    try:
        yield
    finally:
        _scratch.blocks = held


def _row_bytes(df: DataFrame) -> Column:
    total = F.lit(16)
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(col), F.lit(0)) + 8
        elif isinstance(field.dataType, T.ArrayType):
            total = total + F.greatest(F.size(col), F.lit(0)) * 8 + 16
        else:
            total = total + 8
    return total


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes), computed by one aggregation."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df).cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the measured size allows; otherwise leave the join to Spark.

    ``df`` is measured by running it, so pass something checkpointed or cheap.
    """
    return F.broadcast(df) if measure(df)[1] <= limit else df
