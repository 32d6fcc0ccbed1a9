"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned into the principal axes of all of them, so that the
leading coordinates hold most of every inner product. Each vector then goes to one of g blocks of
bounded size, and block pairs are compared in tiles: the products of the leading coordinates are
summed first, and the rest of a pair can add no more than the product of the two suffix norms
(Cauchy-Schwarz). A pair stops as soon as sum and bound together fall below the threshold; what
survives the last stage is decided by the whole product in double precision. Block boundaries follow
the leading coordinate, and a block pair whose ranges lie too far apart for any link is not formed.

A block pair reports for each vector its number of links and the least vector that it reaches inside
the pair, never the links themselves, so a group of n copies costs n rows per block pair and not n².

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing, as do
vectors of a length other than the commonest one with vectors of another length (lengths are compared
apart); a row without an id links with nothing, counts for nobody and is kept, in no component;
repeated ids are one node; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.components import components
from sourcelode.llm.store import settled

THRESHOLD = 0.95
BLOCK_ROWS = 8192
TILE_ROWS = 1024
#: Leading coordinates summed before each test of the bound.
STAGES = (16, 32)
#: Share of a tile's pairs up to which survivors are finished one by one.
DENSE_SHARE = 0.02
#: Slack for rounding: a pair is dropped early only when its bound is below the threshold by this.
SLACK = 1e-9


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit vectors of those): doubles of length one."""
    usable = np.zeros(len(vectors), dtype=bool)
    rows = []
    for i, vector in enumerate(vectors):
        if vector is None or any(x is None for x in vector):
            continue
        row = np.asarray(vector, dtype=np.float64)
        peak = np.abs(row).max(initial=0.0)
        if not np.isfinite(peak) or peak == 0.0:
            continue
        row = row / peak
        usable[i] = True
        rows.append(row / np.sqrt((row * row).sum()))
    return usable, np.array(rows)


def _units(df: DataFrame) -> DataFrame:
    """(vec_id, unit) of the vectors that can link; units are doubles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                usable, rows = unit_rows([vector])
                if usable[0]:
                    ids.append(vec_id)
                    units.append(rows[0].astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "unit"]
            )

    return df.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, unit binary")


def principal_axes(units: DataFrame, width: int) -> np.ndarray:
    """Axes of the second moments of all vectors, strongest first; only a width x width sum travels."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _matrix(batch.column(0).to_pylist())
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    sums = units.select("unit").mapInArrow(moments, "m binary").collect()
    total = sum((np.frombuffer(r["m"]).reshape(width, width) for r in sums), np.zeros((width, width)))
    return np.linalg.eigh(total)[1][:, ::-1]


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1)


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the pairs of two tiles, in principal axes, that reach the threshold.

    One product of the leading coordinates with the suffix norms as a further coordinate gives the
    bound of every pair. Few pairs survive as a rule and are then finished one by one; while many do,
    the next stage is computed for the whole tile.
    """
    width = left.shape[1]
    stops = [*(s for s in STAGES if s < width), width]
    for done in stops:
        bound = _with_suffix(left, done) @ _with_suffix(right, done).T
        rows, columns = np.nonzero(bound >= threshold - SLACK)
        if len(rows) <= DENSE_SHARE * bound.size:
            break
    partial = bound[rows, columns] - _suffix(left, done)[rows] * _suffix(right, done)[columns]
    for stop in (s for s in stops if s > done):
        partial = partial + np.einsum("ij,ij->i", left[rows, done:stop], right[columns, done:stop])
        done = stop
        bound = partial + _suffix(left, done)[rows] * _suffix(right, done)[columns]
        alive = bound >= threshold - SLACK
        rows, columns, partial = rows[alive], columns[alive], partial[alive]
    if len(rows) <= DENSE_SHARE * len(left) * len(right):
        partial = np.einsum("ij,ij->i", left[rows], right[columns])
    alive = partial >= threshold
    return rows[alive], columns[alive]


def _with_suffix(rows: np.ndarray, done: int) -> np.ndarray:
    return np.column_stack([rows[:, :done], _suffix(rows, done)])


def _suffix(rows: np.ndarray, start: int) -> np.ndarray:
    return np.sqrt((rows[:, start:] ** 2).sum(axis=1))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the two ends of each link the lesser label, until nothing changes."""
    while len(a):
        least = np.minimum(labels[a], labels[b])
        open_ = (labels[a] != least) | (labels[b] != least)
        if not open_.any():
            return
        a, b, least = a[open_], b[open_], least[open_]
        roots = np.r_[labels[a], labels[b]]
        np.minimum.at(labels, roots, np.r_[least, least])
        while not np.array_equal(labels, jumped := labels[labels]):
            labels[:] = jumped


def _compare(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        rows = rows.sort_values(["block", "vec_id"]).reset_index(drop=True)
        matrix, cut = _matrix(rows["unit"].tolist()), int((rows["block"] == i).sum())
        count, labels = np.zeros(len(rows), np.int64), np.arange(len(rows))
        second = range(0, cut, TILE_ROWS) if i == j else range(cut, len(rows), TILE_ROWS)
        for a in range(0, cut, TILE_ROWS):
            left = matrix[a : min(a + TILE_ROWS, cut)]
            for b in second:
                if i == j and b < a:
                    continue
                right = matrix[b : min(b + TILE_ROWS, cut if i == j else len(rows))]
                x, y = tile_links(left, right, threshold)
                x, y = x + a, y + b
                if a == b:
                    x, y = x[x < y], y[x < y]
                count += np.bincount(np.r_[x, y], minlength=len(rows))
                join_labels(labels, x, y)
        ids = rows["vec_id"].to_numpy()
        linked = np.flatnonzero(count)
        return pd.DataFrame({"vec_id": ids[linked], "links": count[linked], "least": ids[labels[linked]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    units = settled(_units(vectors), "units")
    sizes = units.groupBy(F.octet_length("unit").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = None
    for size in sorted(sizes, key=lambda r: r["bytes"]):
        same = units.where(F.octet_length("unit") == size["bytes"])
        part = _links(same, size["bytes"] // 8, size["n"], threshold, block_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "vec_id bigint, links bigint, least bigint")
    found = settled(found, "linked")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    groups = groups.withColumnRenamed("node", "vec_id").withColumnRenamed("component", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return (
        vectors.select("vec_id").join(links, "vec_id", "left").join(groups, "vec_id", "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
        )
    )


def _links(units: DataFrame, width: int, n: int, threshold: float, block_rows: int) -> DataFrame:
    axes = principal_axes(units, width)
    blocks = max(1, math.ceil(n / block_rows))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = _matrix(batch.column("unit").to_pylist()) @ axes if batch.num_rows else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([row.tobytes() for row in turned], pa.binary()),
                    pa.array(turned[:, 0] if width else np.zeros(len(turned))),
                ],
                names=["vec_id", "unit", "lead"],
            )

    turned = settled(units.mapInArrow(turn, "vec_id bigint, unit binary, lead double"), "turned")
    shares = [k / blocks for k in range(1, blocks)] or [0.5]
    cuts = sorted(set(turned.agg(F.percentile_approx("lead", shares, 10_000).alias("c")).first()["c"]))

    @F.pandas_udf("int")
    def block_of(lead: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, lead, side="left").astype(np.int32))

    blocked = turned.withColumn("block", block_of("lead"))
    counts = blocked.groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high")
    )
    spans = sorted(counts.collect(), key=lambda r: r["block"])
    # A block above its size, where many vectors share the leading coordinate, is cut by a hash.
    parts = [(r["block"], k, r["low"], r["high"]) for r in spans for k in range(math.ceil(r["n"] / (2 * block_rows)))]
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + SLACK
    pairs = [
        (x, i, j)
        for i, a in enumerate(parts) for j, b in enumerate(parts)
        if i <= j and b[2] - a[3] <= reach and a[2] - b[3] <= reach
        for x in {i, j}
    ]
    spark = units.sparkSession
    first = {b: min(i for i, p in enumerate(parts) if p[0] == b) for b in {p[0] for p in parts}}
    slots = spark.createDataFrame(
        [(r["block"], first[r["block"]], math.ceil(r["n"] / (2 * block_rows))) for r in spans],
        "block int, first int, slots int",
    )
    partners = spark.createDataFrame(pairs, "part int, i int, j int")
    dealt = (
        blocked.join(F.broadcast(slots), "block")
        .withColumn("part", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("slots"))).cast("int"))
        .drop("block")
        .join(F.broadcast(partners), "part")
        .select("vec_id", "unit", F.col("part").alias("block"), "i", "j")
    )
    return dealt.groupBy("i", "j").applyInPandas(_compare(threshold), "vec_id bigint, links bigint, least bigint")
