"""Packing long texts into chunks and pooling chunk vectors back into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelode.functions.text import CHUNK_BYTES, cut_lines, line_ends
from sourcelode.functions.vectors import exact_part, exact_total, vector_ok


def pack_lines(
    df: DataFrame, text: str = "text", limit: int = CHUNK_BYTES, keep_text: bool = False
) -> DataFrame:
    """One row per chunk: ``chunk_no, n_chunks, chunk, oversize``; joining the chunks with newlines
    gives the text back. A single line at or over the limit stays whole and is marked ``oversize``."""
    kept = [c for c in df.columns if keep_text or c != text]
    lines = df.withColumn("_lines", F.split(F.col(text), "\n", -1))
    cut = lines.withColumn(
        "_ends", line_ends(F.transform("_lines", lambda line: F.octet_length(line)), limit)
    )
    exploded = cut.select(
        *kept,
        (F.size("_ends") + 1).alias("n_chunks"),
        F.posexplode(cut_lines(F.col("_lines"), F.col("_ends"))).alias("chunk_no", "chunk"),
    )
    bare = F.octet_length(F.replace("chunk", F.lit("\n"), F.lit("")))
    return exploded.withColumn("oversize", bare >= limit)


def pool_chunks(
    chunks: DataFrame, key: Sequence[str], dim: int, mode: str = "window", vector: str = "vector"
) -> DataFrame:
    """One row per key: ``embedding, n_chunks, embed_tokens, error``.

    ``chunks`` holds ``chunk_no`` (zero-based), ``n_chunks``, the vector, ``tokens`` and ``error``.
    Any failed, missing or ill-sized chunk leaves the key with an error and no embedding.

    A text of one chunk has that chunk's vector, without a shuffle. All others send their numbers by
    slot to exact sums, which are merged where the numbers lie and again by slot: no task holds the
    chunks of one text, and the result has the same bits in whatever order and partitions the chunks
    come. ``chunks`` is read once per case: checkpoint it when it is costly.
    """
    if mode not in ("window", "mean"):
        raise ValueError(f"unknown pooling mode: {mode}")
    bad = F.coalesce("error", F.when(~vector_ok(F.col(vector), dim), "bad_vector"))
    checked = chunks.select(
        *key, "chunk_no", "n_chunks", "tokens", F.col(vector).cast("array<float>").alias("_v"), bad.alias("_bad")
    )
    fields = ["embedding", "n_chunks", "embed_tokens", "error"]

    single = checked.where("n_chunks = 1").select(
        *key,
        F.when(F.col("_bad").isNull(), F.col("_v")).alias("embedding"),
        "n_chunks",
        F.col("tokens").cast("long").alias("embed_tokens"),
        F.col("_bad").alias("error"),
    )

    # Each chunk of several sends its numbers to their slots, and its count and tokens to slots below 0.
    place = F.lit(dim).cast("long") * F.col("chunk_no")

    def part(x: Column, j: Column) -> Column:
        slot = F.floor((place + j) / F.col("n_chunks")) if mode == "window" else j
        return F.struct(slot.cast("int").alias("slot"), *exact_part(x), F.lit(None).cast("string").alias("bad"))

    def extra(slot: int, units: Column, bad: Column) -> Column:
        return F.struct(F.lit(slot).alias("slot"), F.lit(0).alias("scale"), units.cast("long").alias("units"), bad.alias("bad"))

    status = F.array(extra(-1, F.lit(1), F.col("_bad")), extra(-2, F.coalesce("tokens", F.lit(0)), F.lit(None).cast("string")))
    numbers = F.when(F.col("_bad").isNull(), F.transform("_v", part))
    sent = F.concat(status, F.coalesce(numbers, F.slice(status, 1, 0)))
    parts = checked.where("n_chunks > 1").select(*key, "n_chunks", F.inline(sent))
    sums = parts.groupBy(*key, "slot", "scale").agg(
        F.sum("units").alias("units"), F.min("bad").alias("bad"), F.max("n_chunks").alias("n_chunks")
    )
    totals = sums.groupBy(*key, "slot").agg(
        exact_total(F.collect_list(F.struct("scale", "units"))).alias("total"),
        F.sum("units").alias("units"), F.min("bad").alias("bad"), F.max("n_chunks").alias("n_chunks"),
    )
    seen, tokens = (F.sum(F.when(F.col("slot") == slot, F.col("units"))) for slot in (-1, -2))
    missing = F.when(seen != F.max("n_chunks"), "missing_chunk")
    slots = F.array_sort(F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", "total"))))
    texts = totals.groupBy(*key).agg(
        slots.alias("_slots"), F.max("n_chunks").alias("n_chunks"), tokens.alias("embed_tokens"),
        F.coalesce(F.min("bad"), missing).alias("error"),
    )
    mean = F.transform("_slots", lambda t: (t["total"] / F.col("n_chunks")).cast("float"))
    large = texts.select(*key, F.when(F.col("error").isNull(), mean).alias("embedding"), *fields[1:])
    return single.unionByName(large)
