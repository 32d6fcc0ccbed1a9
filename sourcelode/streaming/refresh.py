"""Incremental refresh as a stream: new files flow into the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sourcelode.plans.jobs import Models, refresh_index
from sourcelode.schema import FILES
from sourcelode.session import fresh_path
from sourcelode.sources.index_table import IndexTable


def refresh_from(stream: DataFrame, index: IndexTable, models: Models, progress: str | None = None) -> StreamingQuery:
    """Refresh the index from a stream of files in the shape of ``FILES``, as far as there are any, then stop.

    The index itself is the only state: a replayed batch finds its fingerprints there and writes
    nothing. Keep ``progress`` (the stream's checkpoint folder) to go on where the last run ended.
    """

    def one_batch(batch: DataFrame, _: int) -> None:
        refresh_index(index, batch, models)

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", progress or fresh_path(index.spark, "refresh-progress"))
        .trigger(availableNow=True)
        .start()
    )


def refresh_stream(
    spark: SparkSession,
    source: str,
    index: IndexTable,
    models: Models,
    progress: str | None = None,
    schema: T.StructType = FILES,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Refresh the index from all Parquet files in ``source`` not yet seen."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return refresh_from(reader.parquet(source), index, models, progress)
