"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lowered in A-Z and cut into words. A window is ``size`` consecutive words of a benchmark
item; an item with fewer words, but at least one, is one window. The items, normalised, are handed to
the tasks in blocks of bounded bytes; a task makes the set of window hashes of its block once, scans
the windows of each text against it and verifies every hit word by word. Words inside any occurrence
are hit. A benchmark beyond one block is scanned block by block, each scan keeps only the hits, and
the hits of a text (known by its digest, so copies share them) are put together at the end.

Cases: a null or empty text, or one without words, has no words and no hits; items with null or
wordless text match nothing, items with a null id are left out; repeated items count once; an empty
benchmark leaves all documents clean; an empty table gives no row. Repeated documents are rows of
their own. Other columns pass through; the result's name makes way for a column of the same name.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelode.llm.store import free_name, settled
from sourcelode.llm.text import LOWER, mix, slices, span_hashes, text_bytes
from sourcelode.session import broadcast_if_small

SIZE = 10
BLOCK_BYTES = 16 * 1024 * 1024
#: Words of a piece of a long item; pieces overlap by a window less one word.
PIECE_WORDS = 4096

#: Bytes that belong to words once A-Z are lowered: digits, letters and all of other alphabets.
WORD = np.ones(256, dtype=bool)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False

_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)

SPANS = T.ArrayType(T.StructType().add("start", T.LongType()).add("stop", T.LongType()))
RESULT = T.StructType().add("n_words", T.LongType()).add("n_hit", T.LongType()).add(
    "items", T.ArrayType(T.StringType())
).add("spans", SPANS)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ]
)


class Words:
    """The lowered words of some texts: where they stand, their hashes, and each text's first word."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        self.data = LOWER[data]
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = WORD[self.data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        before = np.r_[False, inside[:-1]]
        self.starts = np.flatnonzero(inside & (cut | ~before))
        self.stops = np.flatnonzero(before & (cut | ~inside))
        self.offsets = offsets
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(self.data, self.starts, self.stops)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words inside one text."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * _powers(_STEP, n), out=sums[1:])
        at = np.arange(n - size + 1)
        text = np.searchsorted(self.first, at, side="right") - 1
        at = at[at + size <= self.first[1:][text]]
        total = (sums[at + size] - sums[at]) * _powers(_STEP_INVERSE, n)[at]
        return at, mix(total ^ np.uint64(size))

    def joined(self, first: int, size: int) -> bytes:
        return b" ".join([self.data[self.starts[w] : self.stops[w]].tobytes() for w in range(first, first + size)])


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base))
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class WindowSet:
    """All windows of some normalised items by their hash."""

    def __init__(self, items: list[str], texts: list[str], size: int):
        words = Words(pa.array(texts, pa.large_string()))
        counts = np.diff(words.first)
        found: dict[int, dict[bytes, set[str]]] = {}
        self.sizes = sorted({min(size, int(c)) for c in counts if c})
        for length in self.sizes:
            at, keys = words.windows(length)
            text = np.searchsorted(words.first, at, side="right") - 1
            whole = np.ones(len(at), bool) if length == size else counts[text] == length
            for first, key, owner in zip(at[whole].tolist(), keys[whole].tolist(), text[whole].tolist(), strict=True):
                found.setdefault(key, {}).setdefault(words.joined(first, length), set()).add(items[owner])
        self.windows = found
        self.keys = np.sort(np.fromiter(found, np.uint64, len(found)))
        # A bitmap of the hashes' low bits answers most lookups with one read.
        bits = max(10, 4 + len(found).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.marked = np.zeros(1 << bits, dtype=bool)
        self.marked[self.keys & self.mask] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of every verified occurrence."""
        for size in self.sizes:
            at, keys = words.windows(size)
            near = self.marked[keys & self.mask]
            at, keys = at[near], keys[near]
            place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            for k in np.flatnonzero(self.keys[place] == keys).tolist() if len(self.keys) else ():
                items = self.windows[int(keys[k])].get(words.joined(int(at[k]), size))
                if items:
                    yield int(at[k]), size, items


def _scan(words: Words, sets: list[WindowSet]) -> tuple[dict[int, set[str]], np.ndarray]:
    """(items by text, number of occurrences over each word)."""
    cover = np.zeros(len(words.starts) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for windows in sets:
        for first, size, found in windows.hits(words):
            cover[first] += 1
            cover[first + size] -= 1
            text = int(np.searchsorted(words.first, first, side="right")) - 1
            items.setdefault(text, set()).update(found)
    return items, np.cumsum(cover[:-1])


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _found(words: Words, sets: list[WindowSet], earlier: list | None = None) -> list[dict]:
    """One RESULT per text; ``earlier`` are results of other scans to be joined in."""
    items, cover = _scan(words, sets)
    results = []
    for text in range(len(words.first) - 1):
        first, last = int(words.first[text]), int(words.first[text + 1])
        hit, named = cover[first:last] > 0, items.get(text, set())
        if earlier and earlier[text]:
            hit, named = hit.copy(), named.union(earlier[text]["items"])
            for span in earlier[text]["spans"]:
                hit[span["start"] : span["stop"]] = True
        results.append({"n_words": last - first, "n_hit": int(hit.sum()), "items": sorted(named), "spans": _spans(hit)})
    return results


def pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, words): the normalised items, long ones in overlapping pieces, without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            items, texts = [], []
            for row, item in enumerate(batch.column("item").to_pylist()):
                first, last = int(words.first[row]), int(words.first[row + 1])
                for begin in range(first, max(first + 1, last - size + 1), PIECE_WORDS):
                    if begin < last:
                        items.append(item)
                        texts.append(words.joined(begin, min(PIECE_WORDS + size - 1, last - begin)).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "words"])

    wanted = benchmark.where("item_id is not null and text is not null")
    wanted = wanted.select(F.col("item_id").cast("string").alias("item"), "text")
    return wanted.mapInArrow(run, "item string, words string").distinct()


def _blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[pa.Table]:
    """The pieces in blocks of about ``block_bytes``, one at least."""
    cut = settled(pieces(benchmark, size), "windows")
    total = cut.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 32).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for block in range(blocks):
        yield cut.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).toArrow()


_made: dict[str, WindowSet] = {}


class Sent:
    """A block on its way to the tasks; each worker makes its window set once."""

    def __init__(self, spark: SparkSession, block: pa.Table, size: int):
        self.name, self.size = uuid.uuid4().hex, size
        self.block = spark.sparkContext.broadcast(block)

    def windows(self) -> WindowSet:
        if self.name not in _made:
            items, texts = (self.block.value.column(c).to_pylist() for c in ("item", "words"))
            _made.clear()
            _made[self.name] = WindowSet(items, texts, self.size)
        return _made[self.name]


def with_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str = "contamination",
    size: int = SIZE,
    block_bytes: int = BLOCK_BYTES,
    cleaned: str | None = None,
) -> DataFrame:
    """``docs`` plus a struct: n_words, n_hit, items (as sorted strings), spans (word numbers, stop exclusive).

    ``docs`` has ``text``, ``benchmark`` has (item_id, text). ``cleaned`` names a further column: the
    text without its hit words and what stands between neighbouring ones.
    """
    name = free_name(docs.columns, name)
    cleaned = cleaned and free_name([*docs.columns, name], cleaned)
    spark = docs.sparkSession
    blocks = _blocks(benchmark, size, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return docs.mapInArrow(_annotate(Sent(spark, first, size), None, name, cleaned), _schema(docs, name, cleaned))

    parts, block = [], first
    while block is not None:
        sent = Sent(spark, block, size)
        keyed = docs.where("text is not null").select(F.sha2("text", 256).alias("key"), "text")
        parts.append(settled(keyed.mapInArrow(_sparse(sent), T.StructType().add("key", "string").add("hits", RESULT)), "hits"))
        sent.block.destroy()
        block, second = second, None
        block = block if block is not None else next(blocks, None)
    # Copies of a text have equal hits, so a key has one row per block at the most.
    hits = reduce(DataFrame.unionByName, [p.dropDuplicates(["key"]) for p in parts])
    hits = settled(
        hits.groupBy("key").agg(
            F.struct(
                F.max("hits.n_words").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                F.array_distinct(F.flatten(F.collect_list("hits.items"))).alias("items"),
                F.flatten(F.collect_list("hits.spans")).alias("spans"),
            ).alias("hits")
        ),
        "hits",
    )
    key, earlier = free_name(docs.columns, "key"), free_name(docs.columns, "earlier")
    hits = broadcast_if_small(hits.select(F.col("key").alias(key), F.col("hits").alias(earlier)))
    joined = docs.withColumn(key, F.sha2("text", 256)).join(hits, key, "left").select(*docs.columns, earlier)
    return joined.mapInArrow(_annotate(None, earlier, name, cleaned), _schema(docs, name, cleaned))


def _schema(docs: DataFrame, name: str, cleaned: str | None) -> T.StructType:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, RESULT)])
    return schema.add(cleaned, "string") if cleaned else schema


def _annotate(sent: Sent | None, earlier: str | None, name: str, cleaned: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [sent.windows()] if sent else []
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            before = batch.column(earlier).to_pylist() if earlier else None
            results = _found(words, sets, before)
            kept = [c for c in batch.schema.names if c != earlier]
            columns = [*(batch.column(c) for c in kept), pa.array(results, _ARROW)]
            if cleaned:
                columns.append(pa.array(_without(batch.column("text"), words, results), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, name, *([cleaned] if cleaned else [])])

    return run


def _sparse(sent: Sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [sent.windows()]
        for batch in slices(batches, "text"):
            results = pa.array(_found(Words(batch.column("text")), sets), _ARROW)
            hit = pc.greater(pc.struct_field(results, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), results], names=["key", "hits"]).filter(hit)

    return run


def _without(texts: pa.Array, words: Words, results: list[dict]) -> list[str | None]:
    """The texts without their hit spans; a null text stays null."""
    cleaned = []
    for row, (text, result) in enumerate(zip(texts.to_pylist(), results, strict=True)):
        if not result["spans"]:
            cleaned.append(text)
            continue
        data, begin, first = text.encode(), int(words.offsets[row]), int(words.first[row])
        kept, at = [], 0
        for span in result["spans"]:
            kept.append(data[at : int(words.starts[first + span["start"]]) - begin])
            at = int(words.stops[first + span["stop"] - 1]) - begin
        cleaned.append(b"".join([*kept, data[at:]]).decode())
    return cleaned


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without those that hold a benchmark window."""
    name = free_name(docs.columns, "contamination")
    return with_contamination(docs, benchmark, name, size).where(F.col(f"{name}.n_hit") == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with the hit spans cut out of their texts."""
    name = free_name(docs.columns, "contamination")
    clean = free_name([*docs.columns, name], "cleaned")
    found = with_contamination(docs, benchmark, name, size, cleaned=clean)
    return found.withColumn("text", F.col(clean)).select(*docs.columns)
