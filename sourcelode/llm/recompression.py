"""Periodic runs of words by recompression.

The words of a batch of texts, as numbers, are compressed in turns: first every block of one repeated
symbol becomes one symbol, then the symbols are dealt to two sides and every neighbouring left-right
pair becomes one symbol. The levels together are a run-length grammar in which equal stretches of
words are parsed alike but for their ends, so the longest common extension of two positions is found
by climbing the levels while the symbols agree and descending to the first difference.

Candidates lie on harmonic grids: a run of period p and length L has L - p neighbouring places whose
word is repeated p words on, so for each p it is enough to look at every max(2p, 24 - p)-th place,
about n log n places in all. The grammar's extensions to both sides give each candidate's exact ends.

Cases: a null or empty text has no words and no runs; a text below 24 words has no runs; words are
compared exactly as they stand; very long texts are handled alone in a batch, in memory in proportion
to their words. Empty tables give no row, other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourcelode.llm.store import free_name
from sourcelode.llm.text import mix, slices

LEAST_LENGTH = 24
LEAST_PERIODS = 3
#: Candidate places looked at in one go.
CELLS = 1 << 20
#: Ways of dealing the symbols to two sides, of which the best is taken.
DEALS = 4

RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
RESULT = (
    T.StructType().add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("greatest", RUN)
    .add("collapsed", T.StringType())
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("greatest", _RUN), ("collapsed", pa.string())])


@dataclass
class Level:
    """One level of the grammar and how its symbols join to the next one's."""

    symbols: np.ndarray
    blocks: bool  # whether the next level joins blocks; else pairs
    parent: np.ndarray  # place in the next level
    first: np.ndarray  # by place in the next level: place of its first symbol here
    size: np.ndarray  # by place in the next level: number of its symbols here

    def mirrored(self) -> Level:
        n, m = len(self.symbols), len(self.first)
        return Level(
            self.symbols[::-1].copy(), self.blocks, (m - 1 - self.parent)[::-1].copy(),
            (n - self.first - self.size)[::-1].copy(), self.size[::-1].copy(),
        )


class Grammar:
    """Levels over a sequence of numbers whose first and last one occur nowhere else."""

    def __init__(self, symbols: np.ndarray, enough: int = 2):
        self.levels: list[Level] = []
        names = int(symbols.max()) + 1
        while len(symbols) > enough:
            before = len(symbols)
            for join in (self._blocks, self._pairs):
                symbols, names = join(symbols, names)
            if len(symbols) == before:
                break
        self.top = symbols

    def _next(self, symbols: np.ndarray, starts: np.ndarray, blocks: bool) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(starts)
        size = np.diff(np.r_[first, len(symbols)])
        self.levels.append(Level(symbols, blocks, np.cumsum(starts) - 1, first, size))
        return first, size

    def _blocks(self, symbols: np.ndarray, names: int) -> tuple[np.ndarray, int]:
        starts = np.r_[True, symbols[1:] != symbols[:-1]]
        if starts.all():
            return symbols, names
        first, size = self._next(symbols, starts, True)
        joined = symbols[first].copy()
        long = size > 1
        kinds, at = np.unique(joined[long] * (int(size.max()) + 1) + size[long], return_inverse=True)
        joined[long] = names + at
        return joined, names + len(kinds)

    def _pairs(self, symbols: np.ndarray, names: int) -> tuple[np.ndarray, int]:
        spread = mix(symbols.astype(np.uint64) + np.uint64(len(self.levels) * 0xD1B54A32D192ED03 % 2**64))
        best = np.zeros(0, np.int64)
        for deal in range(DEALS):
            left = (spread >> np.uint64(deal)) & np.uint64(1) == 1
            pairs = np.flatnonzero(left[:-1] & ~left[1:])
            best = pairs if len(pairs) > len(best) else best
        if not len(best):
            return symbols, names
        starts = np.ones(len(symbols), dtype=bool)
        starts[best + 1] = False
        first, size = self._next(symbols, starts, False)
        joined = symbols[first].copy()
        kinds, at = np.unique(symbols[best] * names + symbols[best + 1], return_inverse=True)
        joined[size == 2] = names + at
        return joined, names + len(kinds)

    def mirrored(self) -> Grammar:
        other = object.__new__(Grammar)
        other.levels, other.top = [level.mirrored() for level in self.levels], self.top[::-1].copy()
        return other

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from place ``a`` on equal those from place ``b`` on; a != b throughout."""
        at = np.stack([a, b]).astype(np.int64)
        stopped = np.full(len(a), len(self.levels))
        active = np.arange(len(a))
        for height, level in enumerate(self.levels):
            if not len(active):
                break
            here, ends = self._climb(level, at[:, active])
            at[:, active] = here
            stopped[active[ends]] = height
            active = active[~ends]
        while len(active):
            x, y = at[:, active]
            active = active[self.top[x] == self.top[y]]
            at[:, active] += 1
        for height in range(len(self.levels) - 1, -1, -1):
            level = self.levels[height]
            above = np.flatnonzero(stopped > height)
            x, y = at[:, above]
            p, q = level.first[x], level.first[y]
            same = level.symbols[p] == level.symbols[q]
            shared = np.minimum(level.size[x], level.size[y]) if level.blocks else 1
            step = np.where(same, shared, 0)
            at[0, above], at[1, above] = p + step, q + step
        return at[0] - a

    @staticmethod
    def _climb(level: Level, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places one level up, or here for those that end here, whether they end).

        Places end where their symbols differ. Where only one of them begins a symbol of the next
        level, the symbols up to the next common beginning are compared here.
        """
        a, b = at.copy()
        ends = level.symbols[a] != level.symbols[b]
        inside = lambda x: level.first[level.parent[x]] != x
        open_ = np.flatnonzero(~ends & (inside(a) | inside(b)))
        if level.blocks:
            rest = [level.first[level.parent[x]] + level.size[level.parent[x]] - x for x in (a[open_], b[open_])]
            step = np.minimum(*rest)
            a[open_] += step
            b[open_] += step
            ends[open_] = rest[0] != rest[1]
        else:
            a[open_] += 1
            b[open_] += 1
            second = open_[inside(a[open_]) | inside(b[open_])]
            # A second symbol of a pair on one side only, or two different ones, is a difference.
            same = level.symbols[a[second]] == level.symbols[b[second]]
            a[second[same]] += 1
            b[second[same]] += 1
            ends[second[~same]] = True
        up = ~ends
        a[up], b[up] = level.parent[a[up]], level.parent[b[up]]
        return np.stack([a, b]), ends


def _grid(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of all candidate places, in portions."""
    longest = counts // LEAST_PERIODS
    text = np.repeat(np.arange(len(counts)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = np.maximum((LEAST_PERIODS - 1) * period, LEAST_LENGTH - period)
    places = (counts[text] - 1 - period) // step + 1
    ends = np.cumsum(places)
    begin = 0
    while begin < len(text):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + CELLS, side="right")))
        n = places[begin:stop]
        row = np.repeat(np.arange(begin, stop), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield text[row], starts[text[row]] + number * step[row], period[row]
        begin = stop


def periodic_runs(codes: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of numbers its runs (start, length, period), by start and period.

    A run has length >= max(24, 3 * period), its smallest period, and no neighbour continues it.
    """
    none = np.zeros((0, 3), np.int64)
    found = [none] * len(codes)
    long = [i for i, c in enumerate(codes) if len(c) >= LEAST_LENGTH]
    if not long:
        return found
    # Marks that occur nowhere else stand before, between and after the sequences.
    mark = 1 + max(int(codes[i].max()) for i in long)
    parts = [np.array([mark], np.int64)]
    for k, i in enumerate(long):
        parts += [codes[i], np.array([mark + 1 + k], np.int64)]
    symbols = np.concatenate(parts)
    counts = np.array([len(codes[i]) for i in long])
    starts = 1 + np.cumsum(counts + 1) - (counts + 1)
    grammar = mirrored = None
    rows = []
    for text, place, period in _grid(starts, counts):
        repeats = np.flatnonzero(symbols[place] == symbols[place + period])
        if not len(repeats):
            continue
        if grammar is None:
            grammar = Grammar(symbols, 2 * len(long) + 2)
            mirrored = grammar.mirrored()
        text, place, period = text[repeats], place[repeats], period[repeats]
        after = grammar.extensions(place, place + period)
        last = len(symbols) - 1
        before = mirrored.extensions(last - (place - 1), last - (place + period - 1))
        length = before + after + period
        kept = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
        start = (place - before - starts[text])[kept]
        portion = np.stack([text[kept], start, length[kept], period[kept]], axis=1)
        rows.append(np.unique(portion, axis=0))
    if not any(map(len, rows)):
        return found
    # The same stretch shows up with multiples of its period; the least one counts.
    every = np.unique(np.concatenate(rows), axis=0)
    every = every[np.r_[True, (every[1:, :3] != every[:-1, :3]).any(axis=1)]]
    every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
    cut = np.searchsorted(every[:, 0], np.arange(len(long) + 1))
    for k, i in enumerate(long):
        found[i] = every[cut[k] : cut[k + 1], 1:]
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:-1]) == 0


def greatest(runs: list[dict[str, int]]) -> dict[str, int] | None:
    """The run with the greatest length / period; ties go to the first one."""
    best = None
    for run in runs:
        if best is None or run["length"] * best["period"] > best["length"] * run["period"]:
            best = run
    return best


Edit = Callable[[object, list[bytes]], list[bytes]]


def batch_runs(batch: pa.RecordBatch, text: str, key: str | None, edit: Edit | None) -> tuple[list, list]:
    """(words, runs) of each text of a batch; ``edit`` may first change a row's words by its key."""
    numbers = defaultdict(count().__next__)
    keys = batch.column(key).to_pylist() if key else [None] * batch.num_rows
    words = []
    for name, whole in zip(keys, batch.column(text).to_pylist(), strict=True):
        own = (whole or "").encode().split()
        words.append(edit(name, own) if edit else own)
    codes = [np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)) for own in words]
    return words, periodic_runs(codes)


def with_runs(
    docs: DataFrame, name: str = "repeats", text: str = "text", key: str | None = None, edit: Edit | None = None
) -> DataFrame:
    """``docs`` plus a struct: n_words, runs (start, length, period), the greatest one, collapsed (kept words).

    Words are runs of bytes other than the six ASCII white-space ones. ``edit(key, words)`` gives the
    words to look at instead of a row's own.
    """
    name = free_name(docs.columns, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            results = []
            for words, runs in zip(*batch_runs(batch, text, key, edit), strict=True):
                kept = words if not len(runs) else [w for w, k in zip(words, kept_words(len(words), runs), strict=True) if k]
                listed = [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]
                results.append(
                    {
                        "n_words": len(words), "runs": listed, "greatest": greatest(listed),
                        "collapsed": b" ".join(kept).decode(),
                    }
                )
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, _ARROW)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, RESULT)]))
