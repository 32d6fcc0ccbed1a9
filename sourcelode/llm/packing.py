"""Best-fit packing of token sequences, certified by lower bounds.

Documents are encoded once; only their pieces (id, length) are packed. Pieces are dealt to partitions
of bounded size, and each partition runs best-fit decreasing. A dual feasible function f maps lengths
to weights so that any set of pieces that fits one sequence weighs 1 at most; hence no packing of a
partition needs fewer sequences than its weight, and the largest such bound certifies the count. In
partitions above their bound the sequences with free space are opened, their pieces are dealt anew
among all such partitions, and best-fit decreasing runs again, until every partition is certified or
a round saves fewer sequences than it has partitions.

Cases: a null text is an empty one, whose only token is the end; repeated rows are packed as often as
they occur; an empty table gives no pieces. Ties are broken by document, piece and checksum.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.store import settled
from sourcelode.llm.tokens import vocabulary

CAPACITY = 1024
#: Pieces packed together in one task.
GROUP_PIECES = 40_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint, sequences bigint, bound bigint"


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` ids and the end: full pieces, after a shorter first one."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n + 1, capacity)]


def encode_pieces(documents: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document. Texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                ids = np.append(words.encode(text or ""), np.uint32(end_id)).astype("<u4")
                cuts = cut_points(len(ids), capacity)
                rows += [
                    (doc, i, a, b - a, zlib.crc32(ids[a:b]))
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                ]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: the best of a family of dual feasible functions.

    With a threshold k up to half the capacity: pieces above capacity - k weigh 1, those from k on
    their share, smaller ones nothing (k = 0: the plain sum). With a divisor: a piece of length x
    weighs floor((d + 1) x / capacity) / d unless (d + 1) x is a multiple of the capacity, when it
    keeps its share.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    x = np.arange(capacity + 1)
    total = np.cumsum((count * x)[::-1])[::-1]
    number = np.cumsum(count[::-1])[::-1]
    best = math.ceil(total[0] / capacity)
    for k in range(1, capacity // 2 + 1):
        big = number[capacity - k + 1]
        shared = total[k] - total[capacity - k + 1]
        best = max(best, int(big) + math.ceil(shared / capacity))
    for d in range(1, 101):
        scaled = (d + 1) * x
        whole = scaled % capacity == 0
        weight = np.where(whole, x * d, scaled // capacity * capacity)
        best = max(best, math.ceil(int((count * weight).sum()) / (d * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; pieces come in decreasing length, equal ones in order.

    Sequences are kept in one stack for each free space, and a bit mask names the stacks in use, so
    the tightest fit is the lowest set bit at or above the length.
    """
    sequence = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = used >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            place = stacks[free].pop()
            if not stacks[free]:
                used &= ~(1 << free)
        else:
            free, place, opened = capacity, opened, opened + 1
        sequence[i], offset[i] = place, capacity - free
        if rest := free - length:
            stacks[rest].append(place)
            used |= 1 << rest
    return sequence, offset


def _packer(capacity: int, shift: int):
    keys = [(name, "ascending") for name in ("doc_id", "piece", "ids_crc32", "length")]

    def pack(rows: pa.Table) -> pa.Table:
        # Arrow keeps whole numbers whole where some of them are null.
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
        part, rows = rows.column("part")[0].as_py(), rows.drop_columns(["part"])
        lengths = rows.column("length").to_numpy()
        sequence, offset = best_fit_decreasing(lengths, capacity)
        found = {
            "sequence_id": sequence + ((shift << 28 | part) << 24),
            "offset": offset,
            "sequences": np.full(len(lengths), int(sequence.max()) + 1),
            "bound": np.full(len(lengths), lower_bound(lengths, capacity)),
        }
        for name, values in found.items():
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP_PIECES) -> DataFrame:
    """Assign ``sequence_id`` and ``offset`` to pieces.

    ``sequences`` and ``bound`` are the count and the certified least count of the partition in which
    the piece was last packed.
    """
    names = [field.split()[0] for field in PIECES.split(", ")]

    def deal(rows: DataFrame, salt: int) -> tuple[DataFrame, int]:
        parts = max(1, math.ceil(rows.count() / group))
        key = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts))
        packed = rows.select(*names, key.alias("part")).groupBy("part").applyInArrow(
            _packer(capacity, salt), PACKED
        )
        return settled(packed, "packed"), parts

    done: DataFrame | None = None
    current, _ = deal(pieces, 0)
    for salt in count(1):
        filled = current.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
        gap = current.where("sequences > bound").join(filled, "sequence_id").where(F.col("filled") < capacity)
        opened = settled(gap.select(*current.columns), "opened")
        before = opened.agg(F.countDistinct("sequence_id").alias("n")).first()["n"]
        if before == 0:
            break
        again, parts = deal(opened, salt)
        saved = before - again.agg(F.countDistinct("sequence_id").alias("n")).first()["n"]
        if saved <= 0:
            break
        closed = current.join(opened.select("sequence_id").distinct(), "sequence_id", "left_anti").select(
            *current.columns
        )
        done = closed if done is None else done.unionByName(closed)
        current = again
        if saved < parts:
            break
    return current if done is None else done.unionByName(current)
