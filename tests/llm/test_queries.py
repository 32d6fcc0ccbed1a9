"""The registered queries over a small folder of tables, against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

tokenizers_files = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sourcelode.llm import queries  # noqa: E402
from sourcelode.llm.store import settled  # noqa: E402

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = "<|endoftext|>"


def make_documents() -> list[tuple]:
    pick = random.Random(20)
    words = [f"w{i}" for i in range(300)] + ["The", "the", "naïve", "東京", "don't", "3.14"]
    texts = []
    for i in range(70):
        text = "\n".join(" ".join(pick.choice(words) for _ in range(pick.randint(4, 30))) for _ in range(pick.randint(1, 9)))
        texts.append(text)
        if i % 7 == 0:
            texts.append(text)  # an exact copy
        if i % 9 == 0:
            texts.append(text + " and more")  # a near one
    texts += ["", None, " \n\t ", "one two", "x" * 9000, "word " * 1500, f"a {END} b", "\x1c é  z", "ONE two\tthree four five"]
    rows = [(i, t, "en", "hot" if i % 3 else "other", 1) for i, t in enumerate(texts)]
    return [*rows, (3, rows[3][1], None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_documents()


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int(r[0] % 5 == 0)) for r in rows if r[0] % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bare")
    for name, schema in (
        ("documents", DOCUMENTS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string"),
        ("embeddings", "vec_id bigint, embedding array<float>, label int"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def got(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, bare, name):
    assert queries.QUERIES[name](spark, bare).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(tokenizers_files.path("byte_bpe_50k.json"))
    return lambda text: held.encode(text or "", add_special_tokens=False).ids


def little(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_op2(spark, sf, rows):
    found = {r["doc_id"]: r for r in got(queries.op2_fingerprint(spark, sf))}
    texts = {i: t or "" for i, t, *_ in rows}
    ids = sorted(texts)
    for i, text in texts.items():
        if i == 3:  # stands twice, so its next document may be itself
            continue
        after = texts[ids[ids.index(i) - 1]]  # the next in descending order; after the least the greatest
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i]["near_next"] <= 1 and 0 <= found[i]["near_edited"] <= 1
    by_text = defaultdict(set)
    for i, text in texts.items():
        by_text[text].add(found[i]["fingerprint"])
    assert {len(prints) for prints in by_text.values()} == {1}


def test_op3(spark, sf, rows, library):
    found = got(queries.op3_best_fit_packing(spark, sf))
    wanted = Counter()
    for i, text, *_ in rows:
        ids = [*library(text), 2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[i, piece, a, b - a, zlib.crc32(little(ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in found)
    assert max(math.ceil(total / 1024), min(r["bound"] for r in found)) <= len(sequences) <= total / 1024 * 1.1 + 1


def test_op5(spark, sf, rows):
    import base64

    import tiktoken

    lines = open(tokenizers_files.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    wanted = []
    for i, text, *_ in rows:
        ids = encode(text or "")
        wanted.append((i, len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(tuple(r.values()) for r in got(queries.op5_bpe_tree(spark, sf))) == sorted(wanted)


def test_op6(spark, sf, rows):
    found = got(queries.op6_feistel_sharding(spark, sf))
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sizes and {r["law"] for r in found} == {"rows"}
    shards = defaultdict(list)
    for r in found:
        shards[r["shard"]].append(r["slot"])
    counts = [len(shards[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(slots) == list(range(len(slots))) for slots in shards.values())


def lowered(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}).encode())


def test_op7(spark, sf, rows):
    sets = defaultdict(list)
    for i, text, *_ in rows:
        words = lowered(text)
        sets[i].append({tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set())
    links = {i: {i} for i in sets}
    for i, one in sets.items():
        for j, other in sets.items():
            if any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in one for b in other):
                links[i].add(j)
    component = {i: i for i in sets}
    for _ in sets:
        component = {i: min(component[j] for j in near) for i, near in links.items()}
    wanted = sorted((i, len(s), component[i]) for i, own in sets.items() for s in own)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got(queries.op7_ngram_join(spark, sf))) == wanted


def test_op8_base(spark, sf, rows):
    found = got(queries.op8_suffix_tree_lm(spark, sf))
    tokens = [(i, [*lowered(text), None]) for i, text, *_ in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, words in tokens if not held(i) for w in words)
    total, kinds = sum(counts.values()), len(counts)
    wanted = []
    for i, words in tokens:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        wanted.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), total, base))
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    found_rows = sorted(tuple(r[c] for c in columns) for r in found)
    assert [r[:5] for r in found_rows] == [r[:5] for r in sorted(wanted)]
    assert [r[5] for r in found_rows] == pytest.approx([r[5] for r in sorted(wanted)], abs=1e-6)
    assert all(r["score"] < 0 for r in found)


def test_op9(spark, sf, rows, library):
    wanted, start = [], 0
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*library(text), 0]
        wanted.append((i, start, len(ids), zlib.crc32(little(ids))))
        start += len(ids)
    assert sorted(tuple(r.values()) for r in got(queries.op9_wavelet_shards(spark, sf))) == sorted(wanted)


def test_op10(spark, sf, rows):
    found = got(queries.op10_toxicity(spark, sf))
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.7)


def test_pipeline(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(settled(stage(spark, frames[-1], sf), "stage"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    kept = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames[:-1]]
    assert set(kept[0]) >= set(kept[1]) >= set(kept[2]) >= set(kept[3]) and len(kept[3]) < len(kept[0])
    lines = [line for text in kept[2].values() for line in (text or "").split("\n") if line.strip()]
    assert len(lines) == len(set(lines))  # no line stands twice
    packed = got(frames[-1])
    assert {r["doc_id"] for r in packed} == set(kept[3])
    assert sorted(r["doc_id"] for r in got(corpus_pipeline.run(spark, sf))) == sorted(r["doc_id"] for r in packed)
