"""Language-model scoring by a probabilistic suffix tree over words.

A text is its words, A-Z lowered, and an end. The tree's nodes are contexts of up to two words. Level
by level, the occurrences of every sequence of words are counted over all learning texts, and every
sequence that occurs ``LEAST`` times or more is held, however many there are; the tree grows with
the corpus and is a table, never held whole by the driver or by a task. A context with held
sequences is a node if its next words diverge enough from those of its suffix, the context without its
oldest word (bits of divergence over all its occurrences).

The root holds every word met, less a constant discount, and gives the discounted mass to unseen
words, which are one symbol. A node holds its repeated next words, discounted, and gives the rest to
its suffix. A word is scored from the longest node that is a suffix of what stands before it.

A text's score is a sum over its sequences of one to three words: of a word its root probability, of a
sequence in a node what that node adds to the probability from the suffix, and of a context that is a
node the share that it gives to its suffix, all as logarithms. So sequences are counted per text and
joined with the table of these values. Two shortcuts leave the sums as they are: a bitmap of
``BITMAP`` bits at most leaves out sequences that are not in the table, and of the most frequent ones
``HOT`` rows at most are handed to every task, so that no frequent sequence is a key of the join.

Cases: a null or empty text has one token, the end; with nothing to learn from, every token is
unseen and has probability 1 / 2; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelode.llm.store import freeing, passing, settled
from sourcelode.llm.text import HELD, Tally, slices, span_hashes, text_bytes, word_spans

#: Occurrences of a held sequence.
LEAST = 2
#: Bits that a node must save per next word that it holds.
LEAST_GAIN = 4.0
#: Discount of a next word's count in a node.
DISCOUNT = 0.5
END = -1
#: Bits of a bitmap at most, a power of two, its bits per key before that, and where a key's second place begins.
BITMAP = 1 << 28
BITS_PER_KEY = 16
SECOND = 32
#: Tokens per bucket of a count; rows of the table per bucket of the scoring, up to and beyond ``SPREAD`` buckets.
BUCKET = 1 << 17
FEW_ROWS, MANY_ROWS = 1 << 14, 1 << 21
SPREAD = 24
#: Rows of the table that are handed to every task at most.
HOT = 1 << 20
#: By length: how far the context's key is turned in the key of a sequence.
TURN = {2: 23, 3: 9}


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, text index): per text its begin, words and end. Begin and end are one symbol."""
    data, offsets = text_bytes(column)
    starts, ends, owner = word_spans(data, offsets)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.bincount(owner, minlength=n) + 2)
    symbols = np.full(len(doc), END, dtype=np.int64)
    symbols[np.arange(len(owner)) + 2 * owner + 1] = span_hashes(data, starts, ends).view(np.int64)
    return symbols, doc


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def extend(context: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Keys of sequences of ``length``: of the context's key and that of the sequence's suffix."""
    word, turn = context.view(np.uint64), TURN[length]
    turned = word << np.uint64(turn) | word >> np.uint64(64 - turn)
    return turned.view(np.int64) ^ last


def extended(context: str, last: str, length: int) -> Column:
    """``extend`` over columns."""
    turn = TURN[length]
    turned = F.shiftleft(context, turn).bitwiseOR(F.shiftrightunsigned(context, 64 - turn))
    return turned.bitwiseXOR(F.col(last))


def sequences(symbols: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length, (places, keys) of the sequences, by the place at which they end."""
    one = np.flatnonzero(np.r_[False, doc[1:] == doc[:-1]])
    pairs = extend(symbols[one - 1], symbols[one], 2)
    again = np.flatnonzero(np.r_[False, one[1:] == one[:-1] + 1]) if len(one) else one
    return [(one, symbols[one]), (one, pairs), (one[again], extend(pairs[again - 1], pairs[again], 3))]


class Bitmap:
    """A set of keys that may seem to hold more: a key stands for two bits."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.int64(len(bits) * 8 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = self._is_set(keys & self.mask)
        again = np.flatnonzero(found)
        found[again] = self._is_set(keys[again] >> SECOND & self.mask)
        return found

    def _is_set(self, at: np.ndarray) -> np.ndarray:
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1

    @classmethod
    def of(cls, keys: np.ndarray) -> Bitmap:
        size = bitmap_size(len(keys))
        bits = np.zeros(size, bool)
        bits[places(keys, size)] = True
        return cls(np.packbits(bits, bitorder="little"))


def bitmap_size(keys: int) -> int:
    return max(1 << 10, min(BITMAP, 1 << (BITS_PER_KEY * keys).bit_length()))


def places(keys: np.ndarray, size: int) -> np.ndarray:
    """The bits of ``keys`` in a bitmap of ``size`` bits."""
    return np.concatenate([keys & (size - 1), keys >> SECOND & (size - 1)])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)


def dealt(number: np.ndarray, names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each ``number`` met, with the values of each column that belong to it as bytes."""
    order = np.argsort(number.astype(np.uint16 if len(number) and number.max() < 1 << 16 else np.int64), kind="stable")
    number = number[order]
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else order
    ends = np.r_[first, len(number)]
    arrays = [pa.array(number[first].astype(np.int32))]
    for column in columns:
        offsets = pa.py_buffer((ends * column.itemsize).astype(np.int32))
        arrays.append(pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(column[order])]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """All values of a column of ``dealt`` rows."""
    whole = b"".join(x.as_buffer() for x in table.column(name))
    return np.frombuffer(whole, kind) if whole else np.zeros(0, kind)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The columns of ``batches``, some ``most`` rows at a time; bytes are the keys that they hold."""

    def whole() -> list[np.ndarray]:
        table = pa.Table.from_batches(held)
        return [joined(table, f.name, np.int64) if pa.types.is_binary(f.type) else table.column(f.name).to_numpy() for f in table.schema]

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes // 8 if pa.types.is_binary(batch.schema.field(0).type) else batch.num_rows
        if size >= most:
            yield whole()
            held, size = [], 0
    if size:
        yield whole()


BLOCK_BITS = 1 << 20


def bitmap(keys: DataFrame, count: int) -> Bitmap:
    """The bitmap of ``count`` ``keys`` (key, many of them as bytes or one). Its blocks are made apart, so the
    driver is sent its bits alone."""
    size = bitmap_size(count)
    block = min(size, BLOCK_BITS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,) in gathered(batches, HELD >> 2):
            at = places(part, size)
            yield dealt(at // block, ["block", "at"], [(at % block).astype(np.int32)])

    def fill(rows: pa.Table) -> pa.Table:
        bits = np.zeros(block, bool)
        bits[joined(rows, "at", np.int32)] = True
        return pa.table({"block": rows.column("block")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    parts = keys.select("key").mapInArrow(deal, "block int, at binary")
    bits = np.zeros((size // block, block // 8), np.uint8)
    with freeing(keys.sparkSession):
        rows = parts.groupBy("block").applyInArrow(fill, "block int, bits binary").collect()
    for row in rows:
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return Bitmap(bits.reshape(-1))


def summed(keys: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, in order, with its context and the sum of its counts."""
    order = np.argsort(keys)
    keys = keys[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
    return keys[cut], contexts[order[cut]], np.add.reduceat(counts[order], cut) if len(cut) else counts


class PairTally:
    """Counts of (context, last) of one length, passed on when many are held."""

    def __init__(self, length: int, buckets: int) -> None:
        self.length, self.buckets, self.waiting, self.size = length, buckets, [], 0
        self.held = (np.zeros(0, np.int64),) * 3

    def add(self, keys: np.ndarray, contexts: np.ndarray) -> None:
        self.waiting.append((keys, contexts, np.ones(len(keys), np.int64)))
        self.size += len(keys)
        if self.size > HELD:
            self._settle()

    def _settle(self) -> None:
        self.held = summed(*(np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True)))
        self.waiting, self.size = [], 0

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        """All that is held, when it is ``least`` or more; by context, which is compressed best."""
        if least <= 1 and self.waiting:
            self._settle()
        if len(self.held[0]) >= least:
            order = np.argsort(self.held[1])
            keys, contexts, counts = (x[order] for x in self.held)
            last = extend(contexts, keys, self.length)
            yield dealt(bucket_of(keys, self.buckets), ["bucket", "context", "last", "n"], [contexts, last, counts])
            self.held = (np.zeros(0, np.int64),) * 3


def count_level(texts: DataFrame, length: int, tokens_in: int, known: Broadcast | None = None) -> DataFrame:
    """(context, last, n) of the sequences of ``length`` that occur ``LEAST`` times or more in ``texts``
    (text), which have ``tokens_in`` tokens: the keys of the sequences without the last and without the
    first word.

    Sequences of which one of these two is not in the bitmap ``known`` are left out; they can't be repeated. Counts
    go by buckets of their keys, of which there are so many that each holds few rows.
    """
    buckets = max(1, tokens_in // BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = PairTally(length, buckets)
        for batch in slices(batches, "text"):
            symbols, doc = tokens(batch.column("text"))
            found = sequences(symbols, doc)
            at, keys = found[length - 1]
            if length == 2:
                contexts = symbols[at - 1]
            else:
                by_place = np.zeros(len(symbols), np.int64)
                by_place[found[length - 2][0]] = found[length - 2][1]
                likely = np.zeros(len(symbols), bool)
                likely[found[length - 2][0]] = known.value.has(found[length - 2][1])
                often = likely[at] & likely[at - 1]
                at, keys = at[often], keys[often]
                contexts = by_place[at - 1]
            tally.add(keys, contexts)
            yield from tally.take(HELD)
        yield from tally.take(1)

    def merge(rows: pa.Table) -> pa.Table:
        contexts, last, counts = (joined(rows, name, np.int64) for name in ("context", "last", "n"))
        keys, contexts, counts = summed(extend(contexts, last, length), contexts, counts)
        kept = counts >= LEAST
        keys, contexts, counts = keys[kept], contexts[kept], counts[kept]
        return pa.table({"context": contexts, "last": extend(contexts, keys, length), "n": counts})

    parts = texts.select("text").mapInArrow(run, "bucket int, context binary, last binary, n binary")
    return parts.groupBy("bucket").applyInArrow(merge, "context bigint, last bigint, n bigint")


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c): occurrences of all words and ends in ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in slices(batches, "text"):
            symbols, doc = tokens(batch.column("text"))
            tally.add(sequences(symbols, doc)[0][1])
            yield from tally.take(HELD)
        yield from tally.take(1)

    parts = texts.select("text").mapInArrow(run, "key bigint, n bigint")
    return parts.groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c"))


def grow(counts: DataFrame, suffixes: DataFrame, length: int) -> DataFrame:
    """The held sequences of ``length``: key, n, the probability ``chance`` of the last word after the
    context, and ``gain``, the log10 of what the context's node adds to that from its suffix.

    ``suffixes`` (key, n, chance) are those one word shorter. One row of each node also has the context
    as ``node``, its occurrences and ``rest``, the log10 of the share that it gives to its suffix.
    """
    below = suffixes.select(F.col("key").alias("last"), F.col("chance").alias("below"))
    totals = suffixes.select(F.col("key").alias("context"), F.col("n").alias("total"))
    rows = counts.join(below, "last").join(totals, "context")
    here = Window.partitionBy("context")
    n, total, free = F.col("n"), F.col("total"), F.col("free")
    rows = rows.withColumns({"kinds": F.count(F.lit(1)).over(here), "sum": F.sum("n").over(here), "first": F.min("last").over(here)})
    rows = rows.withColumns({"own": (n - DISCOUNT) / total, "free": 1.0 - (F.col("sum") - DISCOUNT * F.col("kinds")) / total})
    rows = rows.withColumn("mixed", F.col("own") + free * F.col("below"))
    saved = F.sum(n * F.log2(F.col("mixed") / F.col("below"))).over(here) + (total - F.col("sum")) * F.log2("free")
    rows = rows.withColumn("is_node", saved > LEAST_GAIN * (F.col("kinds") + 1))
    one = F.col("is_node") & (F.col("last") == F.col("first"))
    return rows.select(
        extended("context", "last", length).alias("key"), "n",
        F.when(F.col("is_node"), F.col("mixed")).otherwise(F.col("below")).alias("chance"),
        F.when(F.col("is_node"), F.log10(F.col("mixed") / (free * F.col("below")))).alias("gain"),
        F.when(one, F.col("context")).alias("node"), F.when(one, total).alias("node_n"), F.when(one, F.log10("free")).alias("rest"),
    )


def learn(texts: DataFrame, smoothing: float, held: ExitStack) -> tuple[DataFrame, dict]:
    """The values (key, n, score, base, known) of sequences, which add up, and the sums of the counts of
    all tokens over ``texts`` (text). They can be read until ``held`` ends."""
    words = held.enter_context(passing(count_words(texts), "words"))
    sums = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types"),
        F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"),
    ).first().asDict()
    sums["discount"] = (sums["once"] + 1) / (sums["once"] + 2 * sums["twice"] + 2)
    root = (F.col("c") - F.lit(float(sums["discount"]))) / F.lit(float(max(1, sums["tokens"])))
    level = words.where(F.col("c") >= LEAST).select(F.col("word").alias("key"), F.col("c").alias("n"), root.alias("chance"))
    zero = F.lit(0.0)
    values = words.select(
        F.col("word").alias("key"), F.col("c").alias("n"), F.log10(root).alias("score"),
        F.log10(F.col("c") + smoothing).alias("base"), F.lit(1).alias("known"),
    )
    shorter = None
    for length in (2, 3):
        with passing(count_level(texts, length, sums["tokens"], shorter), "counts") as counts:
            if shorter:
                shorter.destroy()
            level = grow(counts, level, length)
            if length == 3:
                level = level.where("gain is not null").drop("chance")
            level = held.enter_context(passing(level, "level"))
        own = level.where("gain is not null").select("key", "n", F.col("gain").alias("score"), zero, F.lit(0))
        rest = level.where("node is not null").select("node", "node_n", "rest", zero, F.lit(0))
        values = values.union(own).union(rest)
        if length == 2:
            shorter = texts.sparkSession.sparkContext.broadcast(bitmap(level, level.count()))
    return values, sums


class Hot(NamedTuple):
    """The values of the most frequent keys, and the base scores of the words among them; keys are sorted."""

    keys: np.ndarray
    score: np.ndarray
    bits: Bitmap
    words: np.ndarray
    base: np.ndarray


def hottest(values: DataFrame) -> tuple[Hot, int, int]:
    """The values of keys that occur a number of times or more, that number, and the rows of other keys."""
    step = F.floor(F.log2("n") * 4).cast("int")
    with freeing(values.sparkSession):
        rows = values.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()
    rows = sorted((r["step"], r["rows"]) for r in rows)
    least, held, others = 1 << 62, 0, sum(size for _, size in rows)
    for at, size in reversed(rows):
        held += size
        if held > HOT:
            break
        least, others = int(np.ceil(2 ** (at / 4))), others - size
    with freeing(values.sparkSession):
        rows = deal_values(values.where(F.col("n") >= least), 1).collect()
    keys, (score, base, known) = merged(*(np.frombuffer(b"".join(r[name] for r in rows), kind) for name, kind in VALUES.items()))
    words, base = keys[known > 0], base[known > 0]
    return Hot(keys, score, Bitmap.of(keys), words, base), least, others


VALUES = {"key": np.int64, "score": np.float64, "base": np.float64, "known": np.int8}
SENT = {"keys": np.int64, "rows": np.int64, "times": np.int32}
SUMS = {
    "row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(),
    "base": pa.float64(), "score": pa.float64(),
}
SUMS_SCHEMA = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double"


def filled(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows of (bucket, ``SENT``, ``SUMS``), with nulls for the columns that are missing."""
    kinds = {"bucket": pa.int32(), **dict.fromkeys(SENT, pa.binary()), **SUMS}
    n = len(columns["bucket"])
    return pa.RecordBatch.from_pydict({k: columns[k] if k in columns else pa.nulls(n, kind) for k, kind in kinds.items()})


def deal_values(values: DataFrame, buckets: int) -> DataFrame:
    """``values`` by bucket, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in gathered(batches, HELD >> 2):
            columns = [c.astype(kind) for c, kind in zip(columns, VALUES.values(), strict=True)]
            yield dealt(bucket_of(columns[0], buckets), ["bucket", *VALUES], columns)

    return values.select(*VALUES).mapInArrow(run, "bucket int, key binary, score binary, base binary, known binary")


def merged(keys: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each key once, in order, with the sums of its values."""
    order = np.argsort(keys)
    keys = keys[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
    return keys[cut], [np.add.reduceat(x[order], cut) if len(cut) else x for x in of]


def look(rows: pa.Table, values: pa.Table) -> pa.Table:
    """``SUMS`` of a bucket: those of documents as they came, and those of the sequences sent."""
    keys, of = merged(*(joined(values, name, kind) for name, kind in VALUES.items()))
    parts = [pa.table({k: pa.nulls(0, kind) for k, kind in SUMS.items()})]
    for sent in zip(*(rows.column(name) for name in SENT), strict=True):
        if sent[0].is_valid:
            wanted, row, times = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(sent, SENT.values(), strict=True))
            found = find(keys, wanted)
            here = np.flatnonzero(found >= 0)
            row, which = np.unique(row[here], return_inverse=True)
            place, times = found[here], times[here]
            points, base, known = (np.bincount(which, weights=x[place] * times, minlength=len(row)) for x in of)
            own = {"row": row, "n_tokens": np.zeros(len(row), np.int64), "known": known, "base": base, "score": points}
            parts.append(pa.table({k: pa.array(own[k]).cast(kind) if k in own else pa.nulls(len(row), kind) for k, kind in SUMS.items()}))
    came = rows.filter(pc.is_null(rows.column("keys")))
    return pa.concat_tables([pa.table({k: came.column(k) for k in SUMS}), *parts])


def score(documents: DataFrame, held_out: Column, smoothing: float = 0.1) -> DataFrame:
    """Score all rows of ``documents`` (doc_id, text), learning from those that are not ``held_out``."""
    rows = documents.select("doc_id", "text", held_out.alias("held_out"))
    with ExitStack() as held:
        with ExitStack() as learning:
            values, sums = learn(rows.where(~F.col("held_out")), smoothing, learning)
            hot, least, others = hottest(values)
            buckets = max(1, min(SPREAD, others // FEW_ROWS), others // MANY_ROWS)
            cold = held.enter_context(passing(deal_values(values.where(F.col("n") < least), buckets), "cold"))
        known = rows.sparkSession.sparkContext.broadcast((hot, bitmap(cold, others)))
        held.callback(known.destroy)
        return settled(look_up(rows, known, cold, buckets, sums, smoothing), "scored", frees=True)


def look_up(
    rows: DataFrame, known: Broadcast, cold: DataFrame, buckets: int, sums: dict, smoothing: float
) -> DataFrame:
    """The scores of ``rows`` (doc_id, text, held_out) by the values that are ``known``, those in ``buckets``
    of ``cold`` and the ``sums`` of ``learn``.

    A text's sequences that are not hot go to the buckets of their keys, where the values are; what a
    bucket adds to each text comes back as sums. What is known of a text before goes through a bucket too.
    """
    unseen = sums["discount"] * sums["types"] / sums["tokens"] if sums["tokens"] else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, others = known.value
        waiting: list[tuple[np.ndarray, ...]] = []

        def deal() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            waiting.clear()
            sent = dealt(bucket_of(columns[0], buckets), ["bucket", *SENT], columns)
            return filled(dict(zip(sent.schema.names, sent.columns, strict=True)))

        for batch in slices(batches, "text"):
            symbols, doc = tokens(batch.column("text"))
            n = batch.num_rows
            row = batch.column("row").to_numpy()
            totals = [np.zeros(n), np.zeros(n), np.zeros(n, np.int64)]
            away, owner = [], []
            for length, (at, keys) in enumerate(sequences(symbols, doc), 1):
                likely = np.flatnonzero(hot.bits.has(keys))
                found = find(hot.keys, keys[likely])
                likely, place = likely[found >= 0], found[found >= 0]
                here = doc[at[likely]]
                totals[0] += np.bincount(here, weights=hot.score[place], minlength=n)
                if length == 1:
                    tokens_of = np.bincount(doc[at], minlength=n)
                    word = find(hot.words, keys[likely])
                    totals[1] += np.bincount(here, weights=hot.base[word], minlength=n)
                    totals[2] += np.bincount(here, minlength=n)
                left = others.has(keys)
                left[likely] = False
                away.append(keys[left])
                owner.append(doc[at[left]])
            away, owner = np.concatenate(away), np.concatenate(owner)
            order = np.lexsort((away, owner))
            away, owner = away[order], owner[order]
            new = np.r_[True, (away[1:] != away[:-1]) | (owner[1:] != owner[:-1])] if len(away) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            waiting.append((away[first], row[owner[first]], np.diff(np.r_[first, len(away)]).astype(np.int32)))
            yield filled(
                {
                    "bucket": pa.array((row % buckets).astype(np.int32)),
                    "row": batch.column("row"),
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "n_tokens": pa.array(tokens_of.astype(np.int64)),
                    "known": pa.array(totals[2]),
                    "base": pa.array(totals[1]),
                    "score": pa.array(totals[0]),
                }
            )
            if sum(len(keys) for keys, *_ in waiting) >= HELD >> 2:
                yield deal()
        if waiting:
            yield deal()

    sent_schema = f"bucket int, keys binary, rows binary, times binary, {SUMS_SCHEMA}"
    sent = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, sent_schema)
    found = sent.groupBy("bucket").cogroup(cold.groupBy("bucket")).applyInArrow(look, SUMS_SCHEMA)
    found = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        *(F.sum(name).alias(name) for name in ("n_tokens", "known", "base", "score")),
    )
    everything = F.lit(float(sums["tokens"] + smoothing * (sums["types"] + 1)))
    unknown = F.col("n_tokens") - F.col("known")
    return found.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"),
        F.lit(sums["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + unknown * F.log10(F.lit(smoothing)) - F.col("n_tokens") * F.log10(everything)).alias("base_score"),
        (F.col("score") + unknown * F.log10(F.lit(float(unseen)))).alias("score"),
    )
