import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from sourcelode.llm import queries  # noqa: E402
from sourcelode.llm.decontamination import remove_documents, remove_spans, with_contamination  # noqa: E402
from sourcelode.llm.hard_negatives import mine_hard_negatives  # noqa: E402
from sourcelode.llm.recompression import Grammar, periodic_runs, with_runs  # noqa: E402

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_op11(doc_id, text):
    words = WORD.findall((text or "").encode())
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-math.inf if not r[2] else -r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2],
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def periodic(pick: random.Random) -> list[int]:
    words: list[int] = []
    for _ in range(pick.randint(0, 5)):
        unit = [pick.randint(0, 3) for _ in range(pick.randint(1, 12))]
        words += unit * pick.randint(1, 9) + unit[: pick.randint(0, len(unit))]
        words += [pick.randint(0, 5) for _ in range(pick.randint(0, 9))]
    return words


def test_extensions_equal_plain_comparison():
    pick = random.Random(5)
    for _ in range(60):
        inner = periodic(pick) or [1]
        symbols = np.array([90, *inner, 91], np.int64)
        grammar = Grammar(symbols)
        both = [(pick.randrange(len(symbols)), pick.randrange(len(symbols))) for _ in range(80)]
        a, b = np.array([x for x in both if x[0] != x[1]]).T
        for g, s in ((grammar, symbols), (grammar.mirrored(), symbols[::-1])):
            for x, y, n in zip(a.tolist(), b.tolist(), g.extensions(a, b).tolist(), strict=True):
                m = 0
                while max(x, y) + m < len(s) and s[x + m] == s[y + m]:
                    m += 1
                assert n == m


def test_runs_equal_brute_force():
    pick = random.Random(6)
    texts = [periodic(pick) for _ in range(300)] + [[], [1] * 23, [1] * 24, [1] * 500, [1, 2] * 100, list(range(99))]
    texts += [[pick.randint(0, 1) for _ in range(400)] for _ in range(20)]
    found = periodic_runs([np.array(t, np.int64) for t in texts])
    assert [list(map(tuple, f.tolist())) for f in found] == [brute_runs(t) for t in texts]


def test_repeats_that_make_no_run():
    words = np.arange(60)
    words[5] = words[1]
    assert [len(r) for r in periodic_runs([words, words[:30]])] == [0, 0]


def test_a_long_periodic_text_stays_cheap():
    words = np.tile(np.arange(1000), 300)
    assert [r.tolist() for r in periodic_runs([words])] == [[[0, 300_000, 1000]]]


def write(spark, folder, **tables):
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts_with_runs(n: int) -> list[tuple]:
    pick = random.Random(7)
    rows = [(i, " ".join(f"w{w}" for w in periodic(pick)), "en", "s", 1) for i in range(n)]
    rows += [(None, None, None, None, None), (10_000, "", "", "", 0), (10_001, " \n\t", None, "s", 3)]
    rows += [(10_002, "é\x1c中 " * 30, "x", "s", 3), (7, rows[7][1], "en", "s", 1), (None, "a b " * 20, "", "", 1)]
    return rows


def test_op11_equals_brute_force(spark, tmp_path):
    rows = texts_with_runs(150)
    sf = write(spark, tmp_path, documents=spark.createDataFrame(rows, DOCUMENTS))
    found = [tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()]
    assert sorted(found, key=str) == sorted((brute_op11(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] > 0 for r in found) > 50


def test_runs_keep_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "mine")], "doc_id bigint, text string, repeats string")
    row = with_runs(docs).first()
    assert row["repeats"] == "mine" and row["_repeats"]["collapsed"] == "a"
    assert with_runs(docs.limit(0)).count() == 0


OWN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return OWN.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_op12(documents, benchmark):
    windows = defaultdict(set)
    for item, text in benchmark:
        words = lowered(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size and item is not None else 0):
            windows[tuple(words[i : i + size])].add(str(item))
    for doc_id, text, *_ in documents:
        words, hit, items = lowered(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if own := windows.get(tuple(words[i : i + size])):
                    items |= own
                    hit |= set(range(i, i + size))
        listed = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        yield doc_id, len(words), len(hit), len(items), listed, bool(hit)


@pytest.fixture(scope="module")
def leaks():
    pick = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["É", "中x", "A1"]
    many = lambda n: pick.choice([" ", ", ", "\n", "."]).join(pick.choice(words) for _ in range(n))
    items = [(i, many(pick.randint(1, 40))) for i in range(60)] + [(100, None), (101, ""), (None, many(12)), (3, many(30))]
    items += [(102, items[5][1]), (103, "unique short"), (104, " ".join(f"long{i}" for i in range(9000)))]
    documents = []
    for i in range(120):
        text = many(pick.randint(0, 60))
        if i % 3 == 0:
            leak = lowered(pick.choice(items[:60])[1])
            text += f" {'; '.join(leak[pick.randint(0, 2):]).upper()} " + many(5)
        documents.append((i, text, "en", "s", 1))
    documents += [(200, None, None, None, None), (201, "", "", "", 0), (None, "Unique, SHORT", "", "", 0), (5, documents[5][1], "", "", 0)]
    documents += [(202, " ".join(f"long{i}" for i in range(4090, 4105)), "", "", 0)]
    return documents, items


def test_op12_equals_brute_force(spark, tmp_path, leaks):
    documents, items = leaks
    sf = write(
        spark, tmp_path, documents=spark.createDataFrame(documents, DOCUMENTS),
        benchmark=spark.createDataFrame(items, "item_id bigint, text string"),
    )
    found = [tuple(r) for r in queries.op12_decontamination(spark, sf).collect()]
    assert sorted(found, key=str) == sorted(brute_op12(documents, items), key=str)
    assert 30 < sum(r[5] for r in found) < len(found)


def test_blocks_of_a_large_benchmark_find_the_same(spark, leaks):
    documents, items = leaks
    docs = spark.createDataFrame(documents, DOCUMENTS).withColumnRenamed("lang", "Contamination")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    whole = with_contamination(docs, benchmark).collect()
    parts = with_contamination(docs, benchmark, block_bytes=20_000).collect()
    assert docs.columns + ["_contamination"] == list(whole[0].asDict())
    assert sorted(map(str, whole)) == sorted(map(str, parts))


def test_hit_spans_and_documents_go(spark):
    docs = spark.createDataFrame([(1, "Keep. A b c! end"), (2, "a b"), (3, None)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert {tuple(r) for r in remove_spans(docs, benchmark).collect()} == {(1, "Keep. ! end"), (2, "a b"), (3, None)}
    assert {r["doc_id"] for r in remove_documents(docs, benchmark).collect()} == {2, 3}
    assert remove_documents(docs, benchmark.limit(0)).count() == 3
    assert remove_spans(docs.limit(0), benchmark).count() == 0


def dot(a, b):
    return max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))


def brute_negatives(rows, every, positives=5, negatives=10):
    kept = {
        (i, label, tuple(math.floor(256 * x) for x in v))
        for i, label, v in rows
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)
    }
    found = []
    for a in (r for r in kept if r[0] % every == 0):
        others = {(-dot(a[2], r[2]), r[0], r[1]) for r in kept if r[0] != a[0] and len(r[2]) == len(a[2])}
        for s, p, _ in sorted(r for r in others if r[2] == a[1])[:positives]:
            inside = sorted(r for r in others if r[2] != a[1] and 30 * -s <= 100 * -r[0] <= 90 * -s)
            found += [(a[0], p, k, r[1], -s, -r[0]) for k, r in enumerate(inside[:negatives], 1)]
    return found


@pytest.mark.parametrize("width, block_bytes", [(16, 1 << 20), (3, 1 << 10)])
def test_hard_negatives_equal_brute_force(spark, width, block_bytes):
    pick = np.random.default_rng(9)
    rows = [(i, int(pick.integers(0, 3)), [float(x) for x in pick.normal(size=width).round(1)]) for i in range(400)]
    rows += [(1000, None, rows[0][2]), (1001, 1, None), (1002, 1, [None] * width), (1003, 1, [math.nan] * width)]
    rows += [(1004, 1, [math.inf] + [0.0] * (width - 1)), (1010, 1, []), (1011, 1, []), (1012, 2, [])]
    rows += [(1020, 0, [0.5, 0.5]), (1021, 0, [0.5, 0.75]), (1022, 1, [0.25, 0.25]), (20, *rows[20][1:]), (None, 1, rows[1][2])]
    rows += [(2000 + i, i % 2, rows[3][2]) for i in range(40)] + [(3000, 0, [3e9] * width), (3001, 0, [2e9] * width), (3003, 1, [1e9] * width)]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    found = mine_hard_negatives(frame.repartition(3), F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect())) == sorted(brute_negatives(rows, 10))
    assert mine_hard_negatives(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_op13_reads_its_table_and_changes_labels(spark, tmp_path):
    pick = np.random.default_rng(10)
    rows = [(i, int(pick.integers(0, 10)), [float(np.float32(x)) for x in pick.normal(size=8)]) for i in range(600)]
    sf = write(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>"))
    changed = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, sf).collect())) == sorted(brute_negatives(changed, 100))
