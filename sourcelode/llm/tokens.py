"""Byte-level BPE vocabularies as rank tables, loaded once per Python worker.

``byte_bpe_50k.json`` and the like are read by the ``tokenizers`` library; when its parts are plain
byte-level BPE whose merge order is the order of ids, the same merges run through ``tiktoken``, which
needs a quarter of the CPU time for equal ids. Any other file is an error. As in the library, the added
tokens of a file stand for their ids wherever a text holds them, and the text between them is encoded
apart. A rank file has no added tokens, and such strings are ordinary text.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

#: Fixed by the format: the split pattern of byte-level BPE files that use their built-in one.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary file: printable bytes stand for themselves,
    the others for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes and ids, and added tokens and ids, of a ``tokenizers`` file, checked to be plain
    byte-level BPE with added tokens that are matched as they stand."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    parts = json.loads(tokenizer.to_str())
    model, split = parts["model"], parts["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and parts["normalizer"] is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex")
        and not split.get("add_prefix_space")
        and not any(model.get(x) for x in ("dropout", "ignore_merges", "fuse_unk", "byte_fallback"))
    )
    added = {x["content"]: x["id"] for x in parts["added_tokens"]}
    plain = plain and not any(x[flag] for x in parts["added_tokens"] for flag in ("single_word", "lstrip", "rstrip"))
    letters = byte_letters()
    if plain:
        ranks = {
            bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added
        }
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        plain = made == sorted(made) and len(made) + 256 == len(ranks)
    if not plain:
        raise ValueError(f"{path} is not plain byte-level BPE")
    return ranks, added


def ranks_of_lines(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Encode and decode by a rank table and added tokens, of which the longest is matched first."""

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int] | None = None, pattern: str = PATTERN) -> None:
        import tiktoken

        self.ranks, self.added = ranks, added or {}
        longest = sorted(filter(None, self.added), key=len, reverse=True)
        self.parts = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.token_bytes = [b""] * (max([*ranks.values(), *self.added.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.token_bytes[i] = token

    def encode(self, text: str) -> np.ndarray:
        if not self.parts or not self.parts.search(text):
            return self._encode_plain(text)
        # Every other part is an added token.
        return np.concatenate(
            [
                np.array([self.added[part]], np.uint32) if i % 2 else self._encode_plain(part)
                for i, part in enumerate(self.parts.split(text))
            ]
        )

    def _encode_plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, which every executor must be able to open."""
    return Vocabulary(*ranks_of_json(path)) if path.endswith(".json") else Vocabulary(ranks_of_lines(path))
