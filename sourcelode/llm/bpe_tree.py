"""Byte-level BPE by a tree reduction.

A text is halved until the parts are short; parts are encoded alone and neighbours are joined. A
join re-encodes a window around the boundary only. The window grows on each side, doubling, until it
ends at a *safe cut*: a space that follows a character which is no white space. The split pattern
has no match with such a space inside or in its look-ahead beyond the cut, so a match ends and
another starts there in any text around it, merges never cross matches, and the tokens outside the
window are those of the whole text. Where a side holds no safe cut the window takes all of it, which
is always right. Joining is associative, so any tree gives the same ids.

Decoding concatenates the bytes of the tokens up the same kind of tree.

Cases: a null or empty text has no tokens; a text of any length is taken whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from sourcelode.llm.tokens import Vocabulary

LEAF_CHARS = 4096
WINDOW_CHARS = 32


class Part(NamedTuple):
    """The code points ``start`` to ``end`` of a text and their ids."""

    start: int
    end: int
    ids: np.ndarray


def _safe(text: str, at: int) -> bool:
    return text[at] == " " and not text[at - 1].isspace() and text[at - 1] > "\x20"


def last_cut(text: str, start: int, end: int) -> int:
    """The last safe cut inside (start, end), sought in growing windows; ``start`` if there is none."""
    width, right = WINDOW_CHARS, end
    while right > start + 1:
        left = max(start + 1, end - width)
        at = right
        while (at := text.rfind(" ", left, at)) >= 0:
            if _safe(text, at):
                return at
        right, width = left, width * 2
    return start


def first_cut(text: str, start: int, end: int) -> int:
    """The first safe cut inside (start, end), sought in growing windows; ``end`` if there is none."""
    width, left = WINDOW_CHARS, start + 1
    while left < end:
        right = min(end, start + width)
        at = left - 1
        while (at := text.find(" ", at + 1, right)) >= 0:
            if _safe(text, at):
                return at
        left, width = max(right, left), width * 2
    return end


def join(vocabulary: Vocabulary, text: str, left: Part, right: Part) -> Part:
    """The part that covers two neighbours."""
    if left.start == left.end:
        return right
    if right.start == right.end:
        return left
    a = last_cut(text, left.start, left.end)
    b = first_cut(text, right.start, right.end)
    kept_left = len(left.ids) - len(vocabulary.encode(text[a : left.end])) if a > left.start else 0
    lost_right = len(vocabulary.encode(text[right.start : b])) if b < right.end else len(right.ids)
    window = vocabulary.encode(text[a:b])
    return Part(
        left.start, right.end, np.concatenate([left.ids[:kept_left], window, right.ids[lost_right:]])
    )


def encode_tree(vocabulary: Vocabulary, text: str, leaf: int = LEAF_CHARS) -> np.ndarray:
    """Ids of a text. Halving stops at ``leaf`` code points."""

    def reduce(start: int, end: int) -> Part:
        if end - start <= max(1, leaf):
            return Part(start, end, vocabulary.encode(text[start:end]))
        middle = (start + end) // 2
        return join(vocabulary, text, reduce(start, middle), reduce(middle, end))

    return reduce(0, len(text)).ids


def decode_tree(vocabulary: Vocabulary, ids: np.ndarray, leaf: int = LEAF_CHARS) -> bytes:
    """Bytes of a sequence of ids."""
    parts = [vocabulary.decode(ids[i : i + leaf]) for i in range(0, len(ids), leaf)] or [b""]
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]
