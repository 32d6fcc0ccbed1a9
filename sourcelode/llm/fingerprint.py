"""Document fingerprints: a quartile digest of hashed byte triplets.

Each window of five bytes adds its three triplets that start at the first byte to 128 buckets. A
bucket's count is replaced by its quartile among the 128 (two bits), so the digest keeps the shape
of the text and not its length, which is stored apart as a logarithm. Two digests are compared by a
bounded sum: quartile steps (0 to 3 per bucket) and the difference of the logarithms.

Cases: a null text is an empty one; texts below three bytes have no triplet and differ by a checksum
of their bytes, carried by every digest; equal texts have equal digests and a likeness of 1.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelode.llm.store import free_name


BUCKETS = 128
LENGTH_STEP = 1.1
LENGTH_WEIGHT = 4
LENGTH_LIMIT = 40
CHECK_WEIGHT = 1
#: Difference of the shapes at which likeness is zero; unrelated texts stand at about half of it.
LIMIT = 3 * BUCKETS + LENGTH_WEIGHT * LENGTH_LIMIT + CHECK_WEIGHT
_SALTS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_ORDERS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Triplet counts per text and bucket."""
    n = len(offsets) - 1
    counts = np.zeros(n * BUCKETS, dtype=np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int32) * BUCKETS, np.diff(offsets))
    wide = data.astype(np.uint32)
    for salt, (a, b, c) in zip(_SALTS, _ORDERS, strict=True):
        size = len(data) - c
        if size <= 0:
            continue
        code = wide[a : a + size] | (wide[b : b + size] << 8) | (wide[c : c + size] << 16)
        bucket = ((code * salt) ^ (code >> 7)) * np.uint32(0x27D4EB2F) >> 25
        whole = owner[:size] == owner[c : c + size]
        counts += np.bincount((owner[:size] + bucket.astype(np.int32))[whole], minlength=n * BUCKETS)
    return counts.reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Hexadecimal digests of the texts: checksum, length and 64 hexadecimal digits of quartiles."""
    counts = bucket_counts(data, offsets)
    ranked = np.sort(counts, axis=1)
    quartile = np.zeros(counts.shape, dtype=np.uint8)
    for part in (1, 2, 3):
        quartile += counts > ranked[:, part * BUCKETS // 4 - 1 : part * BUCKETS // 4]
    packed = quartile[:, 0::4] | quartile[:, 1::4] << 2 | quartile[:, 2::4] << 4 | quartile[:, 3::4] << 6
    sizes = np.diff(offsets)
    length = np.round(np.log1p(sizes) / np.log(LENGTH_STEP)).astype(int)
    raw = data.tobytes()
    return [
        f"{zlib.crc32(raw[a:b]) & 0xFF:02x}{size:03x}{row.tobytes().hex()}"
        for a, b, size, row in zip(offsets[:-1], offsets[1:], length, packed, strict=True)
    ]


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 for equal digests, falling with their difference to 0."""
    if not left:
        return np.zeros(0)
    a, b = (
        np.frombuffer(bytes.fromhex("".join(x[5:] for x in side)), np.uint8).reshape(len(side), -1)
        for side in (left, right)
    )
    gap = np.zeros(len(left))
    for shift in (0, 2, 4, 6):
        step = ((a >> shift) & 3).astype(np.int16) - ((b >> shift) & 3)
        gap += np.abs(step).sum(axis=1)
    size = np.abs(
        np.array([int(x[2:5], 16) for x in left]) - np.array([int(x[2:5], 16) for x in right])
    )
    gap += LENGTH_WEIGHT * np.minimum(size, LENGTH_LIMIT)
    gap += CHECK_WEIGHT * np.array([x[:2] != y[:2] for x, y in zip(left, right, strict=True)])
    return 1.0 - gap / LIMIT


def with_next(df: DataFrame, key: str, text: str, name: str = "next_text") -> DataFrame:
    """Add the text of the next row in descending ``key`` order; the last row's next is the first.

    Rows are dealt to ranges of the key, cut at its quantiles, and the first row of each range is
    lent to the range before it, so a window inside a range is enough and no range is held by one
    task beyond its share. Nulls come last; equal keys are ordered by a hash of the text.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    found = df.agg(F.percentile_approx(key, shares, 10_000).alias("cuts")).first()["cuts"] or []
    own, to, lent, head = (free_name([*df.columns, name], x) for x in ("_own", "_to", "_lent", "_head"))
    cuts = F.array(*(F.lit(c) for c in sorted(set(found)))).cast("array<bigint>")
    # A null key is above no cut, as are the smallest keys.
    ranged = df.withColumn(own, F.size(F.filter(cuts, lambda c: c < F.coalesce(F.col(key), c))))
    heads = sorted(
        (row[own], row[head])
        for row in ranged.groupBy(own).agg(F.max(key).alias(head)).collect()
    )
    if not heads:
        return df.withColumn(name, F.lit(None).cast("string"))
    before = [p for p, _ in [*heads[1:], heads[0]]]
    lenders = spark.createDataFrame(
        [(p, h, q) for (p, h), q in zip(heads, before, strict=True)], f"`{own}` int, `{head}` bigint, `{to}` int"
    )
    is_head = F.col(key).eqNullSafe(F.col(head))
    copies = ranged.join(F.broadcast(lenders), own).withColumn(
        lent,
        F.explode(F.when(is_head, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))),
    )
    copies = copies.withColumn(own, F.when(F.col(lent), F.col(to)).otherwise(F.col(own))).drop(head, to)
    order = Window.partitionBy(own).orderBy(F.col(lent), F.col(key).desc_nulls_last(), F.xxhash64(text))
    following = copies.withColumn(name, F.lead(text).over(order))
    return following.where(~F.col(lent)).drop(own, lent)
