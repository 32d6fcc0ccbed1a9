"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and their groups.

Equal sets are one class, and only one document of each class goes on. The n-grams of a set are
ordered rare first: by the number of occurrences in the corpus of their bucket, then by hash. Bucket
counts come from a table of fixed size, summed over all documents; whatever its size the order is
the same everywhere, which is all that correctness asks, and a larger table only tells frequent
n-grams apart better. Two sets of Jaccard similarity t or more share an n-gram among their first
n - ceil(t n) + 1, so pairs are found by a join on these prefixes.

Candidates pass a length filter, a positional filter (what can still follow the shared places) and
suffix filters (members that must differ, and that can be shared, by ranges of hashes), and are then verified once by
intersecting the whole sets. Only components are asked for, so candidates come in two steps. First
each prefix n-gram ties its documents to a neighbour and to one of similar size, which is linear in
the group. Then, only between documents that are still in different components, all remaining pairs
are taken; a group of copies that the first step has joined gives none.

Cases: a null text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than n has its whole sequence as its only n-gram; rows with equal ids are one document,
whose texts' sets are taken apart and grouped together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.components import components
from sourcelode.llm.store import settled
from sourcelode.llm.text import shingles, slices, span_hashes, text_bytes, word_spans

SIZE = 5
PERCENT = 80
#: Buckets of the frequency table, and of the filter of candidate documents: fixed, whatever the input.
ORDER_BITS = 20
FILTER_BITS = 23
RANGES = 64
MARKS = 4
#: Documents of an n-gram that are ordered by size together; larger groups are salted.
SALT_ROWS = 1000
_BLOCKS = 16


def least_overlap(n, m, percent: int):
    """The smallest intersection of sets of n and m members that reaches the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def text_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    data, offsets = text_bytes(column)
    starts, ends, owner = word_spans(data, offsets)
    grams, owner = shingles(span_hashes(data, starts, ends), owner, size)
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    return [np.unique(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _scan(documents: DataFrame, size: int) -> DataFrame:
    """Per document its set's size and key; per task the counts of its n-grams' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, dtype=np.int64)
        names = ["doc_id", "n", "set_key", "block", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

        def rows(*columns: list) -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in slices(batches, "text"):
            sets = text_sets(batch.column("text"), size)
            n = len(sets)
            counts += np.bincount(_bucket(np.concatenate(sets)), minlength=len(counts))
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            ids = batch.column("doc_id").to_pylist()
            yield rows(ids, [len(s) for s in sets], keys, [None] * n, [None] * n)
        if counts.any():
            blocks = [b.tobytes() for b in counts.reshape(_BLOCKS, -1)]
            none = [None] * _BLOCKS
            yield rows(none, none, none, list(range(_BLOCKS)), blocks)

    schema = "doc_id bigint, n bigint, set_key binary, block int, counts binary"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _order_table(scanned: DataFrame) -> Broadcast:
    """Occurrences per bucket over all documents: 2^20 counts, 8 MB."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts"))
        return pa.table({"block": rows.column("block")[:1], "counts": [total.tobytes()]})

    blocks = (
        scanned.where("block is not null").select("block", "counts").groupBy("block")
        .applyInArrow(add, "block int, counts binary").collect()
    )
    table = np.zeros((_BLOCKS, (1 << ORDER_BITS) // _BLOCKS), dtype=np.int64)
    for row in blocks:
        table[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return scanned.sparkSession.sparkContext.broadcast(table.reshape(-1))


def _prefixes(documents: DataFrame, size: int, percent: int, order: Broadcast) -> DataFrame:
    """Per document the prefix of its set, rare n-grams first, and member counts by range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = text_sets(batch.column("text"), size)
            heads, marks = [], []
            for s in sets:
                marks.append(parities(s))
                ranked = s[np.lexsort((s, order.value[_bucket(s)]))]
                heads.append(ranked[: prefix_length(len(s), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(heads, pa.list_(pa.int64())),
                    pa.array(marks, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "prefix", "marks"],
            )

    schema = "doc_id bigint, n bigint, prefix array<bigint>, marks array<bigint>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _filter_of(ids: DataFrame) -> Broadcast:
    """A bit table of fixed size (1 MB) that has a bit set for every id, for dropping others early."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    bits = (
        ids.select(F.shiftright(spot, 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    table[bits["w"].to_numpy(np.int64)] = bits["b"].to_numpy(np.int64)
    return ids.sparkSession.sparkContext.broadcast(table)


def _sets_of(documents: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, members): the whole sets of the documents in ``ids``, and some others."""
    table = _filter_of(ids)
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("spot").to_numpy()
                yield batch.filter(pa.array((table.value[at >> 6] >> (at & 63) & 1).astype(bool)))

        for batch in slices(wanted(), "text"):
            sets = text_sets(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc_id", "members"],
            )

    return documents.select("doc_id", "text", spot.alias("spot")).mapInArrow(run, "doc_id bigint, members binary")


def parities(members: np.ndarray) -> np.ndarray:
    """For 256 ranges of hashes, whether the set has an odd number of members there, as four integers.

    Where two sets differ in such a bit they differ in a member, so the number of different bits is at
    most the size of their symmetric difference.
    """
    counts = np.bincount((members >> np.uint64(56)).astype(np.int64), minlength=64 * MARKS)
    return np.packbits(counts & 1 == 1, bitorder="little").view("<i8")


def range_counts(members: np.ndarray) -> np.ndarray:
    return np.bincount((members >> np.uint64(58)).astype(np.int64), minlength=RANGES)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Verify a pair: the suffix filter by ranges of hashes, then the intersection."""
    need = least_overlap(len(a), len(b), percent)
    if min(len(a), len(b)) < need:
        return False
    if len(a) + len(b) > 64 and np.minimum(range_counts(a), range_counts(b)).sum() < need:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def _verified(pairs: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = settled(_sets_of(documents, ids, size), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            held = [
                alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                for x, y in zip(left, right, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right")), "b"
    )
    return settled(both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def _candidates(matches: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of matches (a, b, n, m, i, j) after the length and positional filters.

    The smallest places i and j of a pair are those of its first shared n-gram, before which nothing
    is shared.
    """
    first = (
        matches.where("a != b").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        .select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(F.col("m")).alias("n"),
            F.when(F.col("a") < F.col("b"), F.col("m")).otherwise(F.col("n")).alias("m"),
            F.when(F.col("a") < F.col("b"), F.col("i")).otherwise(F.col("j")).alias("i"),
            F.when(F.col("a") < F.col("b"), F.col("j")).otherwise(F.col("i")).alias("j"),
        )
        .groupBy("a", "b", "n", "m").agg(F.min("i").alias("i"), F.min("j").alias("j"))
    )
    can = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return first.where(can * (100 + percent) >= percent * (F.col("n") + F.col("m"))).select("a", "b")


def _near_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Linear in each group: every document with its neighbour by size, and with the first of its
    size class."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    banded = postings.withColumn("band", band)
    heads = banded.groupBy("gram", "band").agg(F.min(F.struct("doc_id", "n", "i")).alias("q"))
    salt = f"pmod(xxhash64(doc_id), cast(ceil(shared / {SALT_ROWS}) as bigint))"
    by_size = f"partition by gram, {salt} order by n, doc_id"
    tied = banded.join(heads, ["gram", "band"]).select(
        "doc_id", "n", "i", "q", F.expr(f"lag(struct(doc_id, n, i)) over ({by_size})").alias("p")
    ).select("doc_id", "n", "i", F.explode(F.array("p", "q")).alias("o"))
    return tied.where("o is not null and o.doc_id != doc_id").select(
        F.col("doc_id").alias("a"), F.col("o.doc_id").alias("b"), "n", F.col("o.n").alias("m"), "i", F.col("o.i").alias("j")
    )


def _far_pairs(postings: DataFrame, marks: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """All matches between documents of different components so far, after the filters.

    Here the suffix filter is the join's own condition: sets of n and m members that share enough
    differ in (100 - percent) / (100 + percent) of n + m members at most.
    """
    label = F.coalesce("component", "doc_id")
    marked = postings.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "gram", "doc_id", "n", "i", label.alias("group")
    )
    mixed = marked.groupBy("gram").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x != y")
    open_ = marked.join(mixed.select("gram"), "gram", "left_semi").join(marks, "doc_id")
    open_ = settled(open_, "open")
    differ = " + ".join(f"bit_count(l.marks[{k}] ^ r.marks[{k}])" for k in range(MARKS))
    l, r = open_.alias("l"), open_.alias("r")
    near = F.expr(f"l.gram = r.gram and l.doc_id < r.doc_id and l.group != r.group"
                  f" and 100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)"
                  f" and {100 + percent} * (least(l.i, r.i) + least(l.n - l.i, r.n - r.i)) >= {percent} * (l.n + r.n)"
                  f" and {100 + percent} * ({differ}) <= {100 - percent} * (l.n + r.n)")  # fmt: skip
    return l.join(r, near).select(
        F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b"),
        F.col("l.n").alias("n"), F.col("r.n").alias("m"), F.col("l.i").alias("i"), F.col("r.i").alias("j"),
    )


def jaccard_groups(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``documents`` (doc_id, text)."""
    scanned = settled(_scan(documents, size), "scan")
    docs = scanned.where("block is null").select("doc_id", "n", "set_key")
    classes = docs.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = docs.join(classes, "set_key").select("doc_id", "rep")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    prefixes = _prefixes(documents, size, percent, _order_table(scanned))
    prefixes = settled(prefixes.where("n > 0").join(reps, "doc_id", "left_semi"), "prefixes")
    shared = prefixes.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("shared"))
    postings = prefixes.select("doc_id", "n", F.posexplode("prefix").alias("i", "gram"))
    postings = settled(postings.join(shared.where("shared > 1"), "gram"), "postings")
    near = settled(_candidates(_near_pairs(postings, percent), percent), "pairs")
    links = _verified(near, documents, size, percent)
    found = components(links)
    far = _candidates(_far_pairs(postings, prefixes.select("doc_id", "marks"), found, percent), percent)
    far = settled(far.join(near, ["a", "b"], "left_anti"), "pairs")
    more = _verified(far, documents, size, percent)
    same = members.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(more).unionByName(same))
    return docs.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
