"""Running sums, and so row numbers, inside groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelode.session import broadcast_if_small, checkpoint


def with_running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, before: str = "before", last: str = "last"
) -> DataFrame:
    """Add ``before``, the sum of ``weight`` over a group's earlier rows, and ``last``, the group's
    greatest ``before``. Weights are integers from 0 on; group columns must not be null.

    A segmented prefix sum in two steps: the rows are range-partitioned over group and order, each
    task adds up its own stretch of every group, and the stretches' totals, one row per group and
    task, are added up and joined back. No task sees more of a group than its range.
    """
    keys = [*group, *order]
    schema = T.StructType([*df.schema.fields]).add("_in", T.LongType()).add("_slice", T.IntegerType())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, total, here = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            weights = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.zeros(batch.num_rows, dtype=bool)
            for name in group:
                column = batch.column(name)
                starts[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = [batch.column(name)[0].as_py() for name in group]
            sums = np.cumsum(weights) - weights
            begins = np.r_[0, np.flatnonzero(starts)]
            sizes = np.diff(np.r_[begins, batch.num_rows])
            carried = total if first == open_group else 0
            own = sums - np.repeat(sums[begins] - np.r_[carried, np.zeros(len(begins) - 1, np.int64)], sizes)
            open_group = [batch.column(name)[-1].as_py() for name in group]
            total = int(own[-1] + weights[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.int64()), pa.array(np.full(batch.num_rows, here, np.int32))],
                names=[*batch.schema.names, "_in", "_slice"],
            )

    # A recomputed range partitioning may cut elsewhere, so the sums are written down.
    placed = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(add_up, schema))
    stretches = placed.groupBy(*group, "_slice").agg(F.sum(weight).alias("_sum"), F.max("_in").alias("_most"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("long")
    starts = stretches.withColumn("_shift", shift).withColumn(last, F.max(F.col("_shift") + F.col("_most")).over(whole))
    starts = starts.drop("_sum", "_most")
    return (
        placed.join(broadcast_if_small(starts), [*group, "_slice"])
        .withColumn(before, F.col("_in") + F.col("_shift"))
        .drop("_in", "_slice", "_shift")
    )
