"""Deterministic stand-ins for the remote models: everything follows from the md5 of the prompt."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd

LOCAL_DIM = 32
CONTEXT_BYTES = 16_384


def _digests(batch: pd.DataFrame) -> list[str]:
    return [hashlib.md5(prompt.encode("utf-8")).hexdigest() for prompt in batch["prompt"]]


def _said(batch: pd.DataFrame, output: list) -> pd.DataFrame:
    return pd.DataFrame(
        {"key": batch["key"], "output": output, "tokens": batch["prompt"].str.len(), "error": None}
    )


def _describe(digest: str) -> str:
    def entries(kind: str, count: int) -> list[dict]:
        return [
            {"name": f"{kind}{i}_{digest[2:6]}", "source_code": f"{kind} {digest[8 * i : 8 * i + 8]}", "purpose": f"{kind} of {digest[-4:]}"}
            for i in range(count)
        ]

    reply = {
        "purpose": f"purpose {digest[:8]}",
        "classes": entries("class", int(digest[0], 16) % 3),
        "functions": entries("function", int(digest[1], 16) % 3),
    }
    text = json.dumps(reply)
    return f"```json\n{text}\n```" if int(digest[2], 16) % 2 else text


def analyse():
    return lambda batch: _said(batch, [_describe(digest) for digest in _digests(batch)])


def embed():
    """32 sixteenths per text, exact in any float width, so that equal distances stay equal."""
    return lambda batch: _said(batch, [[int(c, 16) / 16 for c in digest] for digest in _digests(batch)])


def embed_in_context():
    """The same vectors, but texts of ``CONTEXT_BYTES`` or more are rejected, row by row."""

    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        said = embed()(batch)
        long = batch["prompt"].str.encode("utf-8").str.len() >= CONTEXT_BYTES
        said.loc[long, "error"] = "over the maximum context length"
        return said.assign(output=said["output"].where(~long, None), tokens=said["tokens"].where(~long, 0))

    return fn


_OFFERED = re.compile(r'^\{"file": (.*?), "name": ', re.M)


def route():
    """Names the first file on offer, one that is not, the first again, and the third."""

    def choose(prompt: str) -> str:
        files = _OFFERED.findall(prompt)
        named = [*files[:1], "/not/there", *files[:1], *files[2:3]]
        return json.dumps({"related_files": [{"file": f, "reason": f"because of {n}"} for n, f in enumerate(named)]})

    return lambda batch: _said(batch, [choose(prompt) for prompt in batch["prompt"]])


def summarise():
    return lambda batch: _said(batch, [f"Summary &quot;{digest[:12]}&quot; &amp; more" for digest in _digests(batch)])


def answer():
    return lambda batch: _said(batch, [f"Answer {digest}" for digest in _digests(batch)])
