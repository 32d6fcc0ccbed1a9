"""Texts of an Arrow batch as one byte array, and words and shingles as 64-bit hashes.

A word's hash is a polynomial in its bytes modulo 2^64 over a fixed table of byte values, then
mixed; whole batches are hashed with a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Distinct keys that a task holds before it passes them on.
HELD = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers evenly; a bijection."""
    z = values.astype(np.uint64) + _ODD
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(256, dtype=np.uint64))[LOWER]
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), np.uint64(base))
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[name] = table
    return table[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds ``limit`` bytes of text at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the words, runs without the six ASCII white-space bytes."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~inside))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans with A-Z lowered; equal spans have equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power_table("up", _BASE, len(data)), out=sums[1:])
    shift = _power_table("down", _BASE_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


def shingles(
    words: np.ndarray, owner: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of ``size`` words in one text, in order.

    A text with fewer words, but at least one, gives its whole sequence as one shingle.
    """
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        count = np.diff(np.r_[first, len(owner)])
        length = np.minimum(np.repeat(count, count), size)
        place = np.arange(len(words)) - np.repeat(first, count)
        kept = np.flatnonzero((place == 0) | (place + size <= np.repeat(count, count)))
        total = mix(length[kept].astype(np.uint64))
        for step in range(size):
            more = step < length[kept]
            at = np.where(more, kept + step, kept)
            total = np.where(more, mix(total * _ODD + words[at]), total)
    return total, owner[kept]


class Tally:
    """Counts of 64-bit keys, passed on when many are held."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        if sum(map(len, self.waiting)) > HELD:
            self._settle()

    def _settle(self) -> None:
        keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting = []
        if len(self.keys):
            both = np.concatenate([self.keys, keys])
            order = np.argsort(both, kind="stable")
            both, numbers = both[order], np.concatenate([self.counts, counts])[order]
            cut = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            keys, counts = both[cut], np.add.reduceat(numbers, cut)
        self.keys, self.counts = keys, counts

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        """All that is held, when it is ``least`` keys or more."""
        if least <= 1 and self.waiting:
            self._settle()
        if len(self.keys) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.counts)], names=["key", "n"])
            self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
