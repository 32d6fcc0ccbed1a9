"""Exact nearest neighbours by squared L2 distance, many queries at once.

Queries travel to the corpus in blocks of bounded bytes, one block after the other, and the corpus is
never shuffled. A first look at about the root of its partitions gives every query an upper bound of
its k-th distance, which goes out with the queries; then each task compares its vectors with the block
as one matrix product and emits at most k rows per query, none beyond the bound. With T partitions the
final rank sees some k times the root of T rows per query instead of k times T.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelode.functions.vectors import vector_ok
from sourcelode.session import broadcast_if_small, checkpoint

#: Bytes of queries sent out at once.
BLOCK_BYTES = 64 * 1024 * 1024
CELLS = 4_000_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _keys(batch: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    """Key columns in pandas; whole numbers stay whole where one of them is null."""
    if any(column.null_count for column in batch.columns):
        return batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
    return batch.to_pandas()


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Squared distances of chosen pairs, added up dimension by dimension."""
    total = np.zeros(len(qi))
    for j in range(q.shape[1]):
        gap = x[xi, j] - q[qi, j]
        total += gap * gap
    return total


class _Best:
    """The k best rows per query seen so far in one task, none farther than the query's bound."""

    def __init__(self, numbers: np.ndarray, queries: np.ndarray, bounds: np.ndarray, keys: Sequence[str], k: int):
        self.numbers, self.q, self.keys, self.k = numbers, queries, list(keys), k
        self.norms = (queries * queries).sum(axis=1)
        self.given, self.bound = bounds, bounds.copy()
        self.rows: pd.DataFrame | None = None

    def add(self, x: np.ndarray, keys: pd.DataFrame) -> None:
        if len(x) == 0:
            return
        norms = (x * x).sum(axis=1)
        step = max(1, CELLS // len(x))
        found = []
        for lo in range(0, len(self.q), step):
            q = self.q[lo : lo + step]
            rough = self.norms[lo : lo + step, None] + norms[None, :] - 2.0 * (q @ x.T)
            slack = 8 * q.shape[1] * np.finfo(np.float64).eps * (self.norms[lo : lo + step] + norms.max())
            limit = self.bound[lo : lo + step]
            if len(x) > self.k:
                limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
            qi, xi = np.nonzero(rough <= (limit + 2 * slack)[:, None])
            for at in range(0, len(qi), CELLS):
                a, b = qi[at : at + CELLS] + lo, xi[at : at + CELLS]
                pairs = pd.DataFrame({"_q": a, "dist": _exact(self.q, x, a, b), "_x": b})
                found.append(self._cut(pairs[pairs["dist"].to_numpy() <= self.given[a]], keys))
        kept = [frame for frame in [self.rows, *found] if frame is not None and len(frame)]
        if kept:
            self.rows = self._top(pd.concat(kept, ignore_index=True))
            full = self.rows.groupby("_q")["dist"].agg(["size", "max"])
            full = full[full["size"] >= self.k]
            at = full.index.to_numpy()
            self.bound[at] = np.minimum(self.bound[at], full["max"].to_numpy())

    def _cut(self, pairs: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        picked = keys.iloc[pairs["_x"].to_numpy()].reset_index(drop=True)
        return self._top(pd.concat([pairs[["_q", "dist"]].reset_index(drop=True), picked], axis=1))

    def _top(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_q", "dist", *self.keys], kind="stable", na_position="first")
        return rows.groupby("_q", sort=False).head(self.k)

    def result(self) -> pd.DataFrame | None:
        if self.rows is None:
            return None
        out = self.rows.copy()
        out["_q"] = self.numbers[out["_q"].to_numpy()]
        return out


class _Search:
    """Best rows for queries that each look only inside their own scope."""

    def __init__(self, queries: pa.Table, bounds: np.ndarray | None, dim: int, scope: str | None, keys: Sequence[str], k: int):
        self.dim, self.scope, self.keys = dim, scope, list(keys)
        vectors = _matrix(queries.column("_qv"), dim)
        bounds = np.full(len(vectors), np.inf) if bounds is None else bounds
        names = queries.column("_scope").to_pylist() if scope else [None] * len(vectors)
        members: dict = {}
        for i, name in enumerate(names):
            members.setdefault(name, []).append(i)
        self.best = {
            name: _Best(np.array(rows), vectors[rows], bounds[rows], keys, k) for name, rows in members.items()
        }

    def add(self, batch: pa.RecordBatch | pa.Table) -> None:
        x = _matrix(batch.column("_v"), self.dim)
        keys = _keys(batch.select(self.keys))
        if not self.scope:
            self.best[None].add(x, keys)
            return
        names = batch.column(self.scope).to_pandas()
        for name, rows in names.groupby(names).indices.items():
            if name in self.best:
                self.best[name].add(x[rows], keys.iloc[rows].reset_index(drop=True))

    def result(self, schema: pa.Schema) -> pa.Table | None:
        found = [frame for frame in (b.result() for b in self.best.values()) if frame is not None]
        if not found:
            return None
        return pa.Table.from_pandas(pd.concat(found, ignore_index=True)[schema.names], schema, preserve_index=False)


@dataclass
class Sent:
    """A block of queries at the tasks: ``_id, _qv, _scope``, and how to compare it."""

    queries: Broadcast
    dim: int
    scope: str | None
    key: Sequence[str]
    k: int


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    key: Sequence[str],
    query_key: str,
    dim: int,
    k: int = 10,
    vector: str = "embedding",
    query_vector: str = "embedding",
    scope: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(query_key, rank, *key, dist)``: the k nearest rows per query, ties in key order.

    ``key`` must be unique in the corpus. With ``scope`` (a column of both sides) a query sees only
    rows of its own scope. Vectors that are not ``dim`` real numbers are left out; find them with
    ``vector_ok``.
    """
    q = queries.where(vector_ok(F.col(query_vector), dim)).select(
        F.col(query_key).alias("_id"),
        F.col(query_vector).cast("array<float>").alias("_qv"),
        (F.col(scope) if scope else F.lit(None).cast("string")).alias("_scope"),
    )
    carried = list(dict.fromkeys([*key, *([scope] if scope else [])]))
    x = corpus.where(vector_ok(F.col(vector), dim)).select(*carried, F.col(vector).cast("array<float>").alias("_v"))
    q = checkpoint(q, "queries")
    blocks = max(1, math.ceil(q.count() * (dim * 8 + 64) / block_bytes))
    spark = q.sparkSession

    def search(block: int) -> DataFrame:
        mine = q.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == block).toArrow()
        sent = Sent(spark.sparkContext.broadcast(mine), dim, scope, key, k)
        local = nearest_per_task(x, sent, distance_bounds(x, sent, mine.num_rows))
        ranked = Window.partitionBy("_q").orderBy("dist", *key)
        best = local.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        numbers = pa.table({"_q": pa.array(range(mine.num_rows), pa.int32()), query_key: mine.column("_id")})
        named = best.join(F.broadcast(spark.createDataFrame(numbers)), "_q")
        return named.select(query_key, F.col("rank").cast("long"), *key, "dist")

    if blocks == 1:
        return search(0)
    # Each block is written down before the next one is sent, so one block is out at a time.
    return reduce(DataFrame.unionByName, [checkpoint(search(block), "neighbours") for block in range(blocks)])


def distance_bounds(x: DataFrame, sent: Sent, n_queries: int) -> np.ndarray:
    """An upper bound of each query's k-th distance, from a look at every r-th of about r² partitions.

    The k-th least of any distances is such a bound, so those tasks pass on only a few each. A query
    that meets fewer than k rows there, as where its scope lies elsewhere, stays without a bound.
    """
    partitions = x.rdd.getNumPartitions()
    step = max(1, math.isqrt(partitions))
    few = min(sent.k, math.ceil(2 * sent.k / math.ceil(max(1, partitions) / step)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % step or sent.queries.value.num_rows == 0:
            return
        search = _Search(sent.queries.value, None, sent.dim, sent.scope, sent.key, few)
        for batch in batches:
            search.add(batch)
        for best in search.best.values():
            if best.rows is not None:
                numbers = best.numbers[best.rows["_q"].to_numpy()]
                yield pa.RecordBatch.from_pydict({"_q": pa.array(numbers, pa.int32()), "dist": best.rows["dist"].to_numpy()})

    near = x.mapInArrow(look, "_q int, dist double").groupBy("_q").agg(F.array_sort(F.collect_list("dist")).alias("d"))
    found = near.where(F.size("d") >= sent.k).select("_q", F.col("d")[sent.k - 1].alias("bound")).toArrow()
    bounds = np.full(n_queries, np.inf)
    bounds[found.column("_q").to_numpy()] = found.column("bound").to_numpy()
    return bounds


def nearest_per_task(x: DataFrame, sent: Sent, bounds: np.ndarray) -> DataFrame:
    """``(_q, dist, *key)``: what each task has to offer, by query number; no shuffle."""
    schema = T.StructType().add("_q", T.IntegerType()).add("dist", T.DoubleType())
    schema = T.StructType([*schema.fields, *[x.schema[c] for c in sent.key]])
    arrow, limits = _arrow_schema(schema), x.sparkSession.sparkContext.broadcast(bounds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.queries.value.num_rows == 0:
            return
        search = _Search(sent.queries.value, limits.value, sent.dim, sent.scope, sent.key, sent.k)
        for batch in batches:
            search.add(batch)
        table = search.result(arrow)
        if table is not None:
            yield from table.to_batches()

    return x.mapInArrow(task, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def fetch(hits: DataFrame, corpus: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Bring columns of the hit rows. The hits are few: when measured small, the corpus stays in place."""
    settled = checkpoint(hits)
    wanted = corpus.select(*dict.fromkeys([*key, *columns]))
    return wanted.join(broadcast_if_small(settled), list(key))
