"""Text columns: extension, decoding, fences, entities, composed content, line packing."""

from __future__ import annotations

import re
from html.entities import html5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values ---------------------------------------------------------------------------
CHUNK_BYTES = 8192
FENCE_OPEN = "```json\n"
FENCE = "```"
#: What stands before the file, its kind, its name, its purpose and its source in composed content.
CONTENT_PARTS = ("//file ", " \n//", " name: ", "\n\n// ", "\n")
# ---- end of fixed values --------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Text from the last dot of a file name; empty when there is none or it only leads."""
    return F.regexp_extract(base_name(name), r"(?s)\A.+(\.[^.]*)\z", 1)


def decode_ok(content: Column) -> Column:
    return F.coalesce(F.is_valid_utf8(content), F.lit(False))


def decode_text(content: Column) -> Column:
    """Bytes as text; bytes that are missing or not UTF-8 give an empty text."""
    return F.when(decode_ok(content), content.cast("string")).otherwise(F.lit(""))


def fingerprint(text: Column) -> Column:
    return F.md5(text)


def strip_fence(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit(FENCE_OPEN), F.lit("")), F.lit(FENCE), F.lit(""))
    return F.when(text.startswith(FENCE_OPEN), bare).otherwise(text)


def compose_content(
    file: Column, code_type: Column, name: Column, purpose: Column, source_code: Column
) -> Column:
    values = (file, code_type, name, purpose, source_code)
    return F.concat(*[piece for part, value in zip(CONTENT_PARTS, values, strict=True) for piece in (F.lit(part), value)])


_ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")


def _entity(match: re.Match) -> str:
    decimal, hexadecimal, name = match.groups()
    if name:
        return html5.get(name + ";", match.group())
    code = int(decimal) if decimal else int(hexadecimal, 16)
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return match.group()
    return chr(code)


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Decode closed HTML entities in one pass; anything unknown stays as written."""
    return text.map(lambda t: _ENTITY.sub(_entity, t), na_action="ignore")


def cut_points(lengths: np.ndarray, offsets: np.ndarray, limit: int) -> list[list[int]]:
    """For each text, given its lines' lengths end to end: the lines before which a new chunk starts.

    Running sums give, by one binary search for all lines of all texts, the line at which a chunk that
    begins at a line would end; a text's cuts are then found by following these pointers.
    """
    sums = np.cumsum(lengths, dtype=np.int64)
    before = sums - lengths
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    here = np.arange(len(lengths))
    # A line at or over the limit is a chunk of its own.
    after = np.maximum(np.searchsorted(sums, before + limit, side="left"), here + 1)
    after = np.minimum(after, offsets[1:][text]).tolist()
    cuts = []
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own, at = [], first
        while at < last:
            at = after[at]
            own.append(at - first)
        cuts.append(own[:-1])
    return cuts


def line_ends(lengths: Column, limit: int = CHUNK_BYTES) -> Column:
    """Greedy packing over line lengths: the line numbers before which a new chunk starts.

    A line joins the open chunk while the summed line bytes stay below ``limit``; newlines are free.
    Only the lengths leave the JVM, a batch at a time.
    """

    @F.arrow_udf("array<int>")
    def ends(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        offsets = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]
        cuts = cut_points(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets, limit)
        held = [None if null else own for own, null in zip(cuts, column.is_null().to_pylist(), strict=True)]
        return pa.array(held, pa.list_(pa.int32()))

    return ends(lengths)


def cut_lines(lines: Column, ends: Column) -> Column:
    """Chunks of joined lines, given the lines and the cut points."""
    starts = F.concat(F.array(F.lit(0)), ends)
    stops = F.concat(ends, F.array(F.size(lines)))
    return F.zip_with(
        starts, stops, lambda a, b: F.array_join(F.slice(lines, a + F.lit(1), b - a), "\n")
    )
