"""Token ids as one wavelet matrix per shard, in one compressed file per shard.

Documents are range-partitioned by id, so that shards follow each other in ascending order. A shard's
ids are replaced by their ranks in its own alphabet; bit plane k holds bit k of each rank, from the
highest, and the sequence is stably parted by that bit before the next plane. With a running count of
ones per block, each plane answers rank and select, and so the file gives the token at a place, the
number of times a token occurs before a place, and the place of its k-th occurrence, without being
decoded. A shard is one row of a Parquet file (zstd): document ids, their ends, alphabet, planes and
rank counts.

Cases: a null text is an empty one, which holds the end id alone; an empty table gives no file and no
row; documents with equal ids stand together, ordered by a hash of their text. A shard holds whole
documents, so its size is bounded by ``docs_per_shard`` documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelode.llm.tokens import vocabulary
from sourcelode.session import broadcast_if_small, fresh_path

DOCS_PER_SHARD = 4096
BLOCK_BITS = 512

SHARD = (
    "shard bigint, n_tokens bigint, doc_ids array<bigint>, ends array<bigint>, alphabet binary,"
    " planes array<binary>, ones array<binary>"
)
_ARROW = pa.schema(
    [
        ("shard", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("alphabet", pa.binary()),
        ("planes", pa.list_(pa.binary())),
        ("ones", pa.list_(pa.binary())),
    ]
)


def _ones_before_blocks(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane of whole blocks, and in all."""
    words = np.bitwise_count(plane.view("<u8")).reshape(-1, BLOCK_BITS // 64)
    return np.r_[0, np.cumsum(words.sum(axis=1, dtype=np.int64))].astype("<u4")


class WaveletMatrix(NamedTuple):
    """``planes`` are bytes of whole blocks, lowest bit first; ``ones`` their running counts."""

    size: int
    alphabet: np.ndarray
    planes: list[np.ndarray]
    ones: list[np.ndarray]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
        ranks = np.zeros(int(seen[-1]) + 1 if len(seen) else 0, dtype=np.uint16 if len(seen) <= 1 << 16 else np.uint32)
        ranks[seen] = np.arange(len(seen))
        row, planes, ones = ranks[ids], [], []
        for k in reversed(range(max(1, (len(seen) - 1).bit_length()) if len(seen) else 0)):
            bit = (row >> k) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            plane = np.zeros(-(-len(ids) // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
            plane[: len(packed)] = packed
            planes.append(plane)
            ones.append(_ones_before_blocks(plane))
            row = np.concatenate([row[np.flatnonzero(~bit)], row[np.flatnonzero(bit)]])
        return cls(len(ids), seen.astype("<u4"), planes, ones)

    def decode(self) -> np.ndarray:
        """All ids in order: the parting of each plane is undone, from the lowest."""
        row = np.zeros(self.size, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            ones = np.flatnonzero(bit)
            above = np.empty_like(row)
            above[np.flatnonzero(~bit)] = row[: self.size - len(ones)]
            above[ones] = row[self.size - len(ones) :] | row.dtype.type(1 << k)
            row = above
        return self.alphabet[row]

    def _ones(self, level: int, at: int) -> int:
        """Ones before place ``at`` of a plane."""
        block, inside = divmod(at, BLOCK_BITS)
        if not inside:
            return int(self.ones[level][block])
        first = block * BLOCK_BITS // 8
        bits = np.unpackbits(self.planes[level][first : first + -(-inside // 8)], count=inside, bitorder="little")
        return int(self.ones[level][block]) + int(bits.sum())

    def _zeros(self, level: int) -> int:
        return self.size - int(self.ones[level][-1])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        rank = 0
        for level, plane in enumerate(self.planes):
            bit = plane[at >> 3] >> (at & 7) & 1
            before = self._ones(level, at)
            at = self._zeros(level) + before if bit else at - before
            rank = rank << 1 | int(bit)
        return int(self.alphabet[rank])

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _start(self, symbol: int) -> int:
        """Where the run of a symbol starts below the last plane."""
        start = 0
        for level in range(len(self.planes)):
            before = self._ones(level, start)
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            start = self._zeros(level) + before if bit else start - before
        return start

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before place ``end``."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        at = min(max(end, 0), self.size)
        for level in range(len(self.planes)):
            before = self._ones(level, at)
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            at = self._zeros(level) + before if bit else at - before
        return at - self._start(symbol)

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        ones = self.ones[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK_BITS - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * BLOCK_BITS // 8
        bits = np.unpackbits(self.planes[level][first : first + BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0, of ``token``."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._start(symbol) + k
        for level in reversed(range(len(self.planes))):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            at = self._select_bit(level, bit, at - self._zeros(level) if bit else at)
        return at


def shard_matrix(row: dict) -> WaveletMatrix:
    """The matrix of a shard's row, as read from its file."""
    return WaveletMatrix(
        row["n_tokens"],
        np.frombuffer(row["alphabet"], "<u4"),
        [np.frombuffer(x, np.uint8) for x in row["planes"]],
        [np.frombuffer(x, "<u4") for x in row["ones"]],
    )


def write_shards(
    documents: DataFrame, vocabulary_path: str, end_id: int, docs_per_shard: int = DOCS_PER_SHARD,
    path: str | None = None,
) -> str:
    """Encode all documents and write the shards' files into a folder, whose path is returned."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, docs, parts = vocabulary(vocabulary_path), [], []
        for batch in batches:
            docs += batch.column(0).to_pylist()
            for text in batch.column(1):
                ids = words.encode(text.as_py() or "")
                parts.append(np.append(ids, np.uint32(end_id)))
        if docs:
            matrix = WaveletMatrix.build(np.concatenate(parts))
            row = {
                "shard": TaskContext.get().partitionId(),
                "n_tokens": matrix.size,
                "doc_ids": docs,
                "ends": np.cumsum([len(p) for p in parts]).tolist(),
                "alphabet": matrix.alphabet.tobytes(),
                "planes": [x.tobytes() for x in matrix.planes],
                "ones": [x.tobytes() for x in matrix.ones],
            }
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    path = path or fresh_path(documents.sparkSession, "shards")
    shards = max(1, math.ceil(documents.count() / docs_per_shard))
    (
        documents.select("doc_id", "text")
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(build, SHARD)
        .write.option("compression", "zstd")
        .parquet(path)
    )
    return path


def read_documents(spark, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32."""
    stored = spark.read.schema(SHARD).parquet(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = shard_matrix(row).decode()
                ends = np.array(row["ends"], dtype=np.int64)
                starts = np.r_[0, ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), row["shard"])),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts),
                        pa.array(ends - starts),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = stored.mapInArrow(
        unpack, "shard bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.select(
        "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start")
    )
    return rows.join(broadcast_if_small(starts), "shard").select(
        "doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )
