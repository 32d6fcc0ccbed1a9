"""Sharding by a keyed permutation of the global row numbers.

Rows are numbered in the order of a key. A Feistel network over a grid of about sqrt(n) by sqrt(n)
permutes the numbers; a result outside 0..n-1 is permuted again until it is inside (cycle walking),
which keeps the map a bijection. Position p of the shuffle is slot ``p div shards`` of shard
``p mod shards``, so shard sizes differ by one at most, and the place of any row, and the row number
at any place, can be computed without a table.

Cases: an empty table gives an empty result; equal keys are ordered by the remaining ``order``
columns, and rows equal in all of them are interchangeable; nulls come first. Extra columns are
kept, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.store import free_name, settled
from sourcelode.llm.text import mix

ROUNDS = 6


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least ``n`` cells."""
    rows = max(1, math.isqrt(max(n, 1)))
    return rows, max(1, -(-n // rows))


def _rounds(seed: int) -> list[np.uint64]:
    return list(mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64((seed * 1_000_003) % (1 << 63))))


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of row numbers 0..n-1 in the shuffle."""
    rows, columns = (np.uint64(side) for side in grid(n))
    out = np.asarray(numbers).astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] // columns, out[walking] % columns
        for i, key in enumerate(_rounds(seed)):
            if i % 2:
                left = (left + mix(right ^ key) % rows) % rows
            else:
                right = (right + mix(left ^ key) % columns) % columns
        out[walking] = left * columns + right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def restore(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers at places of the shuffle; the inverse of :func:`permute`."""
    rows, columns = (np.uint64(side) for side in grid(n))
    out = np.asarray(places).astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] // columns, out[walking] % columns
        for i, key in reversed(list(enumerate(_rounds(seed)))):
            if i % 2:
                left = (left + rows - mix(right ^ key) % rows) % rows
            else:
                right = (right + columns - mix(left ^ key) % columns) % columns
        out[walking] = left * columns + right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Add the global row number in ``order``; also return the number of rows.

    Rows are range-partitioned and sorted, so no task holds more than its range. The sorted rows are
    written once, because a range partitioning that is computed again may cut elsewhere; only one
    count a partition goes to the driver.
    """
    slice_, place = free_name(df.columns, "_slice"), free_name(df.columns, "_place")
    local = F.monotonically_increasing_id()
    ranged = settled(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(place, local)
        .withColumn(slice_, F.shiftright(F.col(place), 33))
        .withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    counts = ranged.groupBy(slice_).agg(F.count(F.lit(1)).alias("rows")).collect()
    starts, total = {}, 0
    for row in sorted(counts, key=lambda r: r[slice_]):
        starts[row[slice_]] = total
        total += row["rows"]
    begins = df.sparkSession.createDataFrame(
        [(k, v) for k, v in starts.items()], f"`{slice_}` bigint, `{name}` bigint"
    )
    numbered = (
        ranged.join(F.broadcast(begins), slice_)
        .withColumn(name, F.col(name) + F.col(place))
        .drop(slice_, place)
    )
    return numbered, total


def shard_rows(
    df: DataFrame, order: list[str], shards: int, seed: int = 0, shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """Add ``shard`` and ``slot`` to every row of ``df``."""
    number = free_name([*df.columns, shard, slot], "_number")
    numbered, n = number_rows(df, order, number)

    @F.pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return (
        numbered.withColumn(number, place(F.col(number)))
        .withColumn(shard, (F.col(number) % shards).cast("int"))
        .withColumn(slot, F.expr(f"`{number}` div {shards}"))
        .drop(number)
    )
