"""Hard negatives for contrastive training by a vertical scan (BOND).

Every row counts with the integers floor(scale * x) of its components, and a row's score for an anchor
is their inner product. A task holds a tile of rows by dimension and reads the dimensions in the
order of the anchor's magnitudes, a few at a time. What the unread ones can still add lies between the
sums of their least and greatest contributions in the tile, so rows that cannot reach the asked-for
scores leave the candidate bitmap early; the rest end with exact scores.

Two scans: the first finds each anchor's best rows of its own label (positives), the second, for each
positive, the best rows of other labels whose score lies within two percentages of the positive's.
A task passes on at most k rows per anchor and list, which is little beside the rows it compared.
Anchors travel in blocks of bounded bytes, one block after the other, and rows are never shuffled.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part.
Vectors of different lengths have no score and never meet; empty vectors have score 0. Ties go to the
lesser id. Rows with the anchor's own id are neither positives nor negatives of it. Rows that repeat
an id with the same score count once in a list, and so does a repeated anchor. An anchor without
positives, or a positive without a row in its window, gives no row; an empty table gives none.
Sums beyond 2^53 are made with Python integers; a score beyond +-(2^63 - 1) counts as that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelode.llm.store import settled

SCALE = 256
BLOCK_BYTES = 16 * 1024 * 1024
TILE_ROWS = 8192
#: Dimensions read between two tests of the bounds.
STEP = 8
_EXACT = 2.0**53
_LONG = 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    kept = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & real
    return vectors.select("vec_id", "label", "embedding").where(kept)


def whole_numbers(vectors: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (row numbers, floor(scale * x) as a dimensions x rows matrix of doubles)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    ends = np.cumsum(lengths)
    found = {}
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        at = (ends[rows] - length)[None, :] + np.arange(length)[:, None]
        found[int(length)] = rows, np.ascontiguousarray(values[at])
    return found


def _integers(values: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers, which never lose a digit."""
    flat = np.array([int(v) for v in values.ravel().tolist()] + [None], dtype=object)[:-1]
    return flat.reshape(values.shape)


def _cut(score: int) -> int:
    return max(-_LONG, min(_LONG, score))


class Tile:
    """Rows of one vector length, by dimension, with the least and greatest value of each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.peak = np.abs(columns).max(initial=0.0)
        self.low = columns.min(axis=1) if len(ids) else np.zeros(len(columns))
        self.high = columns.max(axis=1) if len(ids) else np.zeros(len(columns))

    def scan(self, anchor: np.ndarray, rows: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, exact scores) of those of ``rows`` whose score lies in [least, most]."""
        columns, low, high = self.columns, self.low, self.high
        if len(anchor) * self.peak * np.abs(anchor).max(initial=0.0) >= _EXACT:
            anchor, columns, low, high = map(_integers, (anchor, columns, low, high))
        order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
        ends = np.where(anchor > 0, low, high) * anchor, np.where(anchor > 0, high, low) * anchor
        # What the dimensions from each place of the order on can add, at the least and at the most.
        worst, best = (np.append(np.cumsum(e[order][::-1])[::-1], 0) for e in ends)
        score = np.zeros(len(rows), columns.dtype)
        for begin in range(0, len(order), STEP):
            if not len(rows):
                break
            dims = order[begin : begin + STEP]
            score = score + anchor[dims] @ columns[np.ix_(dims, rows)]
            read = begin + len(dims)
            alive = ((score + best[read] >= least) & (score + worst[read] <= most)).astype(bool)
            rows, score = rows[alive], score[alive]
        if score.dtype == object:
            score = np.array([*map(_cut, score.tolist()), None], dtype=object)[:-1]
        alive = ((score >= least) & (score <= most)).astype(bool)
        return rows[alive], score[alive]


class Best:
    """The k best (score, id) seen so far, without repeats."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k and scores.dtype != object:
            # Several rows may share an id and a score, so the cut is made at k distinct ones.
            order = np.lexsort((ids, -scores))
            new = np.r_[True, (np.diff(scores[order]) != 0) | (np.diff(ids[order]) != 0)]
            first = order[new][: self.k]
            scores, ids = scores[first], ids[first]
        fresh = {(-int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)}
        self.held = sorted(fresh.union(self.held))[: self.k]

    def least(self, otherwise: float) -> float:
        """The score that a further row must have at least."""
        return -self.held[-1][0] if len(self.held) == self.k else otherwise


@dataclass
class Search:
    """One list to fill: for an anchor, the ``k`` best rows with a score in [least, most]."""

    anchor: int
    place: int
    least: float
    most: float
    best: Best


def _scan_rows(batches, anchors: pa.Table, scale: int, k: int, windows: dict | None) -> Iterator[pa.RecordBatch]:
    """Fill the lists of all anchors from the rows of one task; ``windows`` None: positives."""
    ids, labels = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
    vectors, searches = {}, {}
    for length, (numbers, columns) in whole_numbers(anchors.column("embedding"), scale).items():
        for at, number in enumerate(numbers.tolist()):
            vectors[number] = columns[:, at]
            bounds = [(0, -math.inf, math.inf)] if windows is None else windows.get(number, [])
            searches.setdefault(length, []).append([Search(number, p, lo, hi, Best(k)) for p, lo, hi in bounds])

    def compare(batch: pa.Table) -> None:
        row_ids, row_labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for length, (rows, columns) in whole_numbers(batch.column("embedding"), scale).items():
            tile = Tile(row_ids[rows], row_labels[rows], columns)
            for lists in searches.get(length, []):
                if not lists:
                    continue
                anchor = lists[0].anchor
                same = tile.labels == labels[anchor]
                wanted = np.flatnonzero((same if windows is None else ~same) & (tile.ids != ids[anchor]))
                least = min(s.best.least(s.least) for s in lists)
                found, scores = tile.scan(vectors[anchor], wanted, least, max(s.most for s in lists))
                for s in lists:
                    inside = ((scores >= s.best.least(s.least)) & (scores <= s.most)).astype(bool)
                    if inside.any():
                        s.best.add(scores[inside], tile.ids[found[inside]])

    held, n_held = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_ROWS):
            held.append(batch.slice(start, TILE_ROWS))
            n_held += held[-1].num_rows
            if n_held >= TILE_ROWS:
                compare(pa.Table.from_batches(held))
                held, n_held = [], 0
    if held:
        compare(pa.Table.from_batches(held))
    for lists in (x for group in searches.values() for x in group):
        for s in lists:
            if s.best.held:
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array([s.anchor] * len(s.best.held), pa.int32()),
                        "place": pa.array([s.place] * len(s.best.held), pa.int32()),
                        "score": pa.array([-n for n, _ in s.best.held], pa.int64()),
                        "found": pa.array([i for _, i in s.best.held], pa.int64()),
                    }
                )


_FOUND = "anchor int, place int, score bigint, found bigint"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of all tasks' lists, ranked from 1."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = SCALE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has (vec_id, label, embedding); anchors are the rows for which ``is_anchor`` holds.
    """
    rows = usable(vectors)
    anchors = settled(rows.where(is_anchor).dropDuplicates(["vec_id", "label", "embedding"]), "anchors")
    size = anchors.agg(F.sum(F.size("embedding").cast("long") * 8 + 64).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    parts = []
    for block in range(blocks):
        mine = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        parts.append(_mine_block(rows, mine.toArrow(), positives, negatives, low_percent, high_percent, scale))
    return reduce(DataFrame.unionByName, parts)


def _mine_block(rows, anchors: pa.Table, positives, negatives, low_percent, high_percent, scale) -> DataFrame:
    """The negatives of one block of anchors, written down so that the block can be let go."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(anchors)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan_rows(batches, sent.value, scale, positives, None)

    # As many rows as the block has anchors times positives, at the most.
    best = _ranked(rows.mapInArrow(near, _FOUND), positives).orderBy("anchor", "rank").toArrow().to_pylist()
    windows: dict[int, list[tuple[int, int, int]]] = {}
    for row in best:
        least, most = -(-low_percent * row["score"] // 100), high_percent * row["score"] // 100
        if least <= most:
            windows.setdefault(row["anchor"], []).append((row["rank"], least, most))
    bounds = spark.sparkContext.broadcast(windows)

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan_rows(batches, sent.value, scale, negatives, bounds.value)

    ids = anchors.column("vec_id").to_pylist()
    known = spark.createDataFrame(
        [(r["anchor"], r["rank"], ids[r["anchor"]], r["found"], r["score"]) for r in best],
        "anchor int, place int, anchor_id bigint, positive_id bigint, positive_score bigint",
    )
    mined = _ranked(rows.mapInArrow(hard, _FOUND), negatives).join(F.broadcast(known), ["anchor", "place"])
    mined = settled(
        mined.select(
            "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        ),
        "negatives",
    )
    sent.destroy()
    bounds.destroy()
    return mined
