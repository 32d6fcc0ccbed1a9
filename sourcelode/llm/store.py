"""Shared helpers: cutting lineage on shared storage, and clash-free column names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sourcelode.session import delete_folder, fresh_path


#: When set, shuffle files of a query are deleted at its end.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession, frees: bool = True) -> Iterator[None]:
    """Queries that run inside the block delete their shuffle files at their end."""
    before = spark.conf.get(FREES, "false")
    spark.conf.set(FREES, "true" if frees else before)
    try:
        yield
    finally:
        spark.conf.set(FREES, before)


def settled(df: DataFrame, label: str, frees: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later uses neither recompute it nor depend on an executor, and read only the columns they need.
    ``frees`` deletes the shuffle files of the writing query when it has ended.
    """
    path = fresh_path(df.sparkSession, label)
    with freeing(df.sparkSession, frees):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` settled, its shuffle files deleted; the folder goes when the block ends, and nothing lazy may outlive it."""
    path = fresh_path(df.sparkSession, label)
    try:
        with freeing(df.sparkSession):
            df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(df.sparkSession, path)


def settled_append(df: DataFrame, label: str, path: str | None) -> str:
    """Add ``df`` to the Parquet folder at ``path`` (a new one when None); return the folder."""
    path = path or fresh_path(df.sparkSession, label)
    df.write.mode("append").parquet(path)
    return path


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name in any case."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted
