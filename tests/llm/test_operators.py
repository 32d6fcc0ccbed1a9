import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sourcelode.llm import fingerprint, sharding
from sourcelode.llm.bpe_tree import decode_tree, encode_tree
from sourcelode.llm.components import components
from sourcelode.llm.embedding_dedup import near_duplicates
from sourcelode.llm.line_dedup import dedup_lines, within_edits
from sourcelode.llm.ngram_join import alike, jaccard_groups, parities
from sourcelode.llm.packing import best_fit_decreasing, cut_points, encode_pieces, lower_bound, pack
from sourcelode.llm.store import settled
from sourcelode.llm.suffix_tree_lm import score
from sourcelode.llm.text import text_bytes
from sourcelode.llm.tokens import vocabulary
from sourcelode.llm.toxicity import train, with_toxicity
from sourcelode.llm.wavelet import WaveletMatrix, read_documents, write_shards

tokenizers = pytest.importorskip("public_tokenizers")
JSON, RANKS = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_multi_50k.tiktoken")
AWKWARD = [(0, None), (1, ""), (2, " \n\t "), (3, "one two three four five six seven " * 40), (4, "one two three four five six seven " * 40), (5, "x" * 5000), (None, "no id"), (7, "tie"), (7, "tie")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def strings(seed: int, n: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice("ab 'sltre\n\t 12! é中\x1c\x85   ") for _ in range(pick.randint(0, 60))) for _ in range(n)]


def test_bpe_tree_equals_the_library_and_round_trips():
    words = vocabulary(RANKS)
    for text in strings(1, 600):
        whole = words.encoding.encode_ordinary(text)
        for leaf in (1, 5, 17):
            assert encode_tree(words, text, leaf).tolist() == whole
        assert decode_tree(words, np.array(whole, np.uint32), 4) == text.encode()


def test_vocabulary_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    for text in strings(2, 600):
        assert vocabulary(JSON).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_permutation_is_a_bijection_with_an_inverse():
    for n in (1, 2, 3, 17, 100, 1001):
        places = sharding.permute(np.arange(n), n, 5)
        assert sorted(places) == list(range(n))
        assert (sharding.restore(places, n, 5) == np.arange(n)).all()


def test_sharding_of_awkward_and_empty_tables(awkward, empty):
    rows = sharding.shard_rows(awkward, ["doc_id", "text"], 4).collect()
    sizes = [sum(r["shard"] == k for r in rows) for k in range(4)]
    assert len(rows) == len(AWKWARD) and max(sizes) - min(sizes) <= 1
    assert sharding.shard_rows(empty, ["doc_id"], 4).count() == 0


def test_fingerprints(awkward):
    digests = fingerprint.digests(*text_bytes(pa.array([None, "", "ab", "text " * 50, "text " * 50])))
    assert digests[0] == digests[1] != digests[2] and digests[3] == digests[4]
    assert fingerprint.likeness(digests[3:4], digests[4:]) == [1.0]
    assert ((0 <= fingerprint.likeness(digests[:3], digests[2:])) & (fingerprint.likeness(digests[:3], digests[2:]) <= 1)).all()
    assert fingerprint.with_next(awkward, "doc_id", "text").count() == len(AWKWARD)


def test_packing_is_gapless_whole_and_within_bounds(spark, awkward, empty):
    packed = pack(settled(encode_pieces(awkward, JSON, 2), "pieces"), group=5).collect()
    used: dict = {}
    for row in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == used.get(row["sequence_id"], 0)
        used[row["sequence_id"]] = row["offset"] + row["length"]
    assert max(used.values()) <= 1024 and sum(r["piece"] == 0 for r in packed) == len(AWKWARD)
    assert pack(settled(encode_pieces(empty, JSON, 2), "pieces")).count() == 0
    assert cut_points(2500, 1024) == [0, 452, 1476, 2500] and cut_points(1024, 1024) == [0, 1024]
    lengths = np.random.default_rng(1).integers(1, 1025, 3000)
    assert lower_bound(lengths) <= best_fit_decreasing(lengths)[0].max() + 1
    assert lower_bound(np.array([600, 600, 600])) == 3


def test_wavelet_matrix_and_shards(spark, awkward, empty):
    ids = np.random.default_rng(2).integers(0, 300, 3000)
    matrix = WaveletMatrix.build(ids)
    assert (matrix.decode() == ids).all()
    for at in (0, 1, 511, 512, 2999):
        assert matrix.access(at) == ids[at] and matrix.rank(7, at) == (ids[:at] == 7).sum()
    places = np.flatnonzero(ids == ids[5])
    assert [matrix.select(int(ids[5]), k) for k in range(len(places))] == places.tolist() and matrix.count(5000) == 0
    rows = read_documents(spark, write_shards(awkward, JSON, 0, 3)).collect()
    assert len(rows) == len(AWKWARD) and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    assert next(r for r in rows if r["doc_id"] == 1)["ids_crc32"] == zlib.crc32(bytes(4))
    assert read_documents(spark, write_shards(empty, JSON, 0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id a", "id + 1 b").unionByName(spark.createDataFrame([(900, 901)], "a bigint, b bigint"))
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {found[n] for n in range(201)} == {0} and found[901] == 900


def test_ngram_groups(awkward, empty):
    found = {r["doc_id"]: r["component_id"] for r in jaccard_groups(awkward).collect()}
    assert found[4] == 3 and found[0] == 0 and found[1] == 1 and found[2] == 2 and found[5] == 5
    assert jaccard_groups(empty).count() == 0


def test_parity_marks_never_exceed_the_difference():
    pick = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(pick.integers(0, 2**63, 80, dtype=np.uint64))
        b = np.unique(np.r_[a[10:], pick.integers(0, 2**63, 9, dtype=np.uint64)])
        differ = sum(int(x ^ y).bit_count() if x ^ y >= 0 else int((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(parities(a).tolist(), parities(b).tolist()))
        assert differ <= len(np.setxor1d(a, b)) and alike(a, b, 70) == (len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.7)


def test_embedding_links(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one), (2, [0.99, 0.05, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0] * 3), (6, [float("nan"), 1.0, 0.0]), (7, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(vectors).collect()}
    assert found[1] == (1, 1, True) and found[2] == (1, 1, False)
    assert all(found[v] == (0, v, True) for v in (3, 4, 5, 6, 7))
    assert near_duplicates(vectors.limit(0)).count() == 0


def test_line_dedup(spark, empty):
    long = "a line that is long enough to be compared"
    rows = [(1, f"{long}\nfirst\n\nkeep"), (2, f"{long[:-1]}X\nfirst\n\nown"), (3, "first"), (4, None), (5, ""), (6, "first\n \n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as _codes", "2 as _key")
    found = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert found == {1: f"{long}\nfirst\n\nkeep", 2: "\nown", 4: None, 5: "", 6: " \n"}
    assert dedup_lines(empty).count() == 0


def test_language_model_prefers_what_it_has_read(spark, awkward, empty):
    from pyspark.sql import functions as F

    rows = [(i, "the cat sat on the mat again") for i in range(60)] + [(99, "the cat sat on the mat again"), (98, "mat the on cat again sat the")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in score(df, F.col("doc_id") >= 90).collect()}
    assert found[99]["score"] > found[98]["score"] and abs(found[99]["base_score"] - found[98]["base_score"]) < 1e-9
    assert score(awkward, F.lit(False)).count() == len(AWKWARD) and score(empty, F.lit(False)).count() == 0


def test_toxicity_learns_and_passes_columns_on(spark, awkward, empty):
    from pyspark.sql import functions as F

    pick = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(pick.choices(words, k=30) + ["nasty"] * 2 * (i % 5 == 0)), i % 5 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id bigint, text string, toxicity int")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id bigint, toxic int")
    fitted = train(docs, labels, F.col("doc_id") < 300)
    scored = with_toxicity(docs, fitted)
    assert scored.columns == ["doc_id", "text", "toxicity", "_toxicity"]
    assert all((r["_toxicity"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in scored.collect())
    assert with_toxicity(awkward, train(awkward, labels.limit(0), F.lit(True))).where("toxicity >= 0.7").count() == 0
    assert with_toxicity(empty, fitted).count() == 0


def test_banded_distance_equals_the_whole_table(spark):
    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    pairs = []
    for _ in range(600):
        a = [rng.choice("aé😀b") for _ in range(rng.randint(3, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "zz"])
        a, b = "".join(a), "".join(b)
        if b:
            pairs.append((max(a, b, key=len), min(a, b, key=len)))
    frame = spark.createDataFrame(pairs, "longer string, shorter string")
    for edits in (1, 2):
        said = frame.selectExpr("longer", "shorter", f"{within_edits(edits)} as near").collect()
        assert all(r["near"] == (distance(r["longer"], r["shorter"]) <= edits) for r in said)
        assert {r["near"] for r in said} == {True, False}


def test_language_model_holds_every_repeated_sequence_and_equals_a_plain_tree(spark, monkeypatch):
    from collections import Counter
    from math import log2, log10

    from pyspark.sql import functions as F

    from sourcelode.llm import suffix_tree_lm as lm

    pick = random.Random(8)
    texts = [" ".join(pick.choices("abcdefgh", k=pick.randint(0, 9))) for _ in range(120)]
    # Two occurrences of one sequence in 250,000 tokens: below a share of 1e-5, three occurrences.
    texts += ["rare pair here"] * 2 + ["x p y"] * 20 + ["z p w"] * 20 + [" ".join(["filler"] * 1000)] * 250
    held = ["rare pair here", "rare pair a", "a x p y", "z p y", "a b c never", "pair here rare", ""]
    learnt, lines = [["", *t.split(), ""] for t in texts], [["", *t.split(), ""] for t in held]
    counts = [Counter(tuple(t[i - k : i + 1]) for t in learnt for i in range(max(1, k), len(t))) for k in range(3)]
    c = counts[0]
    total, once, twice = sum(c.values()), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    discount = (once + 1) / (once + 2 * twice + 2)
    nodes: dict[tuple, tuple[float, dict]] = {}

    def chance(context: tuple, word: str) -> float:
        if not context:
            return (c[word,] - discount) / total if c[word,] else discount * len(c) / total
        free, own = nodes.get(context, (1.0, {}))
        return own.get(word, 0.0) + free * chance(context[1:], word)

    for k in (1, 2):
        for context, n in counts[k - 1].items():
            after = {s[-1]: m for s, m in counts[k].items() if s[:-1] == context and m >= 2}
            free = 1 - sum(m - 0.5 for m in after.values()) / n
            gain = (n - sum(after.values())) * log2(free) if after else 0.0
            for word, m in after.items():
                below = chance(context[1:], word)
                gain += m * log2(((m - 0.5) / n + free * below) / below)
            if after and gain > 4 * (len(after) + 1):
                nodes[context] = free, {word: (m - 0.5) / n for word, m in after.items()}
    assert ("rare",) in nodes and ("x", "p") in nodes
    want = [sum(log10(chance(tuple(t[max(0, i - 2) : i]), t[i])) for i in range(1, len(t))) for t in lines]
    rows = list(enumerate(texts + held))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hot in (lm.HOT, 20, 0):
        monkeypatch.setattr(lm, "HOT", hot)
        found = {r["doc_id"]: r["score"] for r in score(df, F.col("doc_id") >= len(texts)).collect()}
        assert [found[len(texts) + i] for i in range(len(held))] == pytest.approx(want)


def test_vocabulary_equals_the_library_on_texts_that_hold_added_tokens():
    from tokenizers import Tokenizer

    library, pick = Tokenizer.from_file(JSON), random.Random(9)
    (token,) = {x.content for x in library.get_added_tokens_decoder().values()}
    parts = [token, token[:-1], token[1:], *strings(4, 20)]
    for text in [f"a{token}b", token, token * 3, *("".join(pick.choices(parts, k=5)) for _ in range(300))]:
        ids = vocabulary(JSON).encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert vocabulary(JSON).decode(ids) == text.encode()


def test_parities_never_part_near_lines(spark):
    from pyspark.sql import functions as F

    from sourcelode.llm.line_dedup import parities, perhaps_near

    pick, rows = random.Random(11), []
    for line in strings(12, 300):
        other = list(line)
        for _ in range(pick.randint(0, 2)):
            at = pick.randint(0, len(other))
            other[at : at + pick.randint(0, 1)] = pick.choice(["", "q", "é"])
        rows.append((line, "".join(other)))
    marked = spark.createDataFrame(rows, "x string, y string").select(parities("x").alias("p"), parities("y").alias("q"))
    assert marked.where(~perhaps_near(F.col("p"), F.col("q"), 2)).count() == 0


def distance_within(x: str, y: str, edits: int) -> bool:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1] <= edits


@pytest.mark.parametrize(("seed", "task_chars"), [(21, 1 << 22), (22, 30_000)])
def test_crowded_keys_give_all_groups_without_all_pairs(spark, monkeypatch, seed, task_chars):
    from sourcelode.llm import line_dedup

    pick, lines = random.Random(seed), set()
    for base in ("the quick brown fox jumps over a lazy dog é", "aaaaaaaaaaaaaaaaaaaaaaaaabaaaa"):
        lines.add(base)
        for _ in range(50):
            line, at = base, pick.randint(0, len(base))
            line = line[:at] + "".join(pick.choice("xxyy") for _ in range(4)) + line[at:] if pick.random() < 0.7 else line
            for _ in range(pick.randint(0, 3)):
                at = pick.randint(0, len(line))
                line = line[:at] + pick.choice(["", "x", "é", "a"]) + line[at + pick.randint(0, 1) :]
            lines.add(line)
    lines = sorted(x for x in lines if len(x) >= 20)
    part = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if part[i] != part[j] and abs(len(x) - len(lines[j])) <= 2 and distance_within(x, lines[j], 2):
                part = [part[i] if k == part[j] else k for k in part]
    expected = {}
    for line, k in zip(lines, part):
        expected.setdefault(k, set()).add(line)

    written = []

    def spy(df, label, frees=False):
        written.append((label, settled(df, label, frees)))
        return written[-1][1]

    monkeypatch.setattr(line_dedup, "settled", spy)
    monkeypatch.setattr(line_dedup, "TASK_CHARS", task_chars, raising=False)
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id bigint, text string")
    ids = {r["lid"]: r["text"] for r in df.selectExpr("xxhash64(text) as lid", "text").collect()}
    found = {}
    for row in line_dedup.line_groups(df).collect():
        found.setdefault(row["component"], set()).add(ids[row["lid"]])
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in expected.values() if len(x) > 1)
    pairs = [df.count() for label, df in written if label == "pairs"]
    assert len(pairs) == 2 and pairs[1] < 2 * len(lines)


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_under_full_keys_meet_by_copies_without_python(spark, monkeypatch, edits):
    from sourcelode.llm import line_dedup

    pick, rows = random.Random(31 + edits), []
    for crowd in range(120):
        letters = "ab" if crowd % 3 else "abcé\0"
        base, lines = "".join(pick.choices(letters, k=pick.randint(3, 9))), set()
        for _ in range(pick.randint(4, 14)):
            line = base
            for _ in range(pick.randint(0, 4)):
                at = pick.randint(0, len(line))
                line = line[:at] + pick.choice(["", *letters]) + line[at + pick.randint(0, 1) :]
            lines.add(line)
        rows += [(crowd, 1000 * crowd + i, line) for i, line in enumerate(sorted(lines, key=lambda x: pick.random()))]
    text = {lid: line for _, lid, line in rows}
    plans = []

    def spy(df, label, frees=False):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settled(df, label, frees)

    monkeypatch.setattr(line_dedup, "settled", spy)
    monkeypatch.setattr(line_dedup, "GROUP", 1)
    df = settled(spark.createDataFrame(rows, "key bigint, lid bigint, line string").coalesce(1), "rows")
    contents = df.select("lid", "line").withColumn("odd", line_dedup.parities("line"))
    pairs = line_dedup._crowd_pairs(df.selectExpr("key", "lid", "lid as part"), contents, edits).collect()
    assert not any("Pandas" in plan or "Arrow" in plan or "Python" in plan for plan in plans)

    def least(links):
        part = {lid: lid for lid in text}

        def top(x):
            while part[x] != x:
                part[x] = x = part[part[x]]
            return x

        for a, b in links:
            part[top(a)] = top(b)
        groups = {}
        for lid in text:
            groups.setdefault(top(lid), set()).add(lid)
        return sorted(map(sorted, groups.values()))

    assert all(distance_within(text[r["a"]], text[r["b"]], edits) for r in pairs)
    crowds = [[lid for c, lid, _ in rows if c == crowd] for crowd in range(120)]
    near = [(a, b) for lids in crowds for a in lids for b in lids if a < b and distance_within(text[a], text[b], edits)]
    assert least((r["a"], r["b"]) for r in pairs) == least(near)


def test_lines_are_copied_only_where_they_have_more_pairs_than_copies(spark, monkeypatch):
    from sourcelode.llm import line_dedup

    pick = random.Random(41)
    base = "".join(pick.choices("abcdefgh ", k=60))
    lines = set()
    while len(lines) < 150:
        line = base
        for _ in range(pick.randint(1, 4)):
            at = pick.randint(0, len(line))
            line = line[:at] + pick.choice(["", *"abcdefgh"]) + line[at + pick.randint(0, 1) :]
        lines.add(line)
    rows = [(int(i >= 54), i, line) for i, line in enumerate(sorted(lines, key=lambda x: pick.random()))]
    copies = {}

    def spy(df, label, frees=False):
        written = settled(df, label, frees)
        if label == "codes":
            copies[label] = written.count()
        return written

    monkeypatch.setattr(line_dedup, "settled", spy)
    for group in (0, 1):
        here = [(lid, line) for key, lid, line in rows if key == group]
        df = settled(spark.createDataFrame(here, "lid bigint, line string"), "rows").selectExpr("*", "1 as key")
        contents = df.select("lid", "line").withColumn("odd", line_dedup.parities("line"))
        found = line_dedup._crowd_pairs(df.selectExpr("key", "lid", "lid as part"), contents, 2).collect()
        part = {lid: lid for lid, _ in here}
        text = dict(here)
        for a, b in ((r["a"], r["b"]) for r in found if distance_within(text[r["a"]], text[r["b"]], 2)):
            part = {lid: part[a] if p == part[b] else p for lid, p in part.items()}
        assert all(part[a] == part[b] for a in text for b in text if a < b and distance_within(text[a], text[b], 2))
        assert ("codes" in copies) == (group == 1)
    assert copies["codes"] <= 2 * 27 * 96


def test_language_model_leaves_nothing_but_its_scores_and_is_the_same_in_many_buckets(spark, monkeypatch):
    import os

    from pyspark.sql import functions as F

    from sourcelode.llm import suffix_tree_lm as lm
    from sourcelode.session import shared_dir

    pick = random.Random(4)
    texts = [" ".join(pick.choices("abcdefghijkl", k=pick.randint(0, 30))) for _ in range(200)] + [None, ""]
    rows = [(i % 190 if i < 199 else None, text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = shared_dir(spark).removeprefix("file:")
    found = []
    for few, tokens, bits in ((1 << 14, 1 << 17, lm.BITMAP), (1, 50, 1 << 10)):
        for name, value in (("FEW_ROWS", few), ("BUCKET", tokens), ("BITMAP", bits), ("HOT", 30)):
            monkeypatch.setattr(lm, name, value)
        before = set(os.listdir(folder))
        scored = score(df, F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)))
        assert [name.split("-")[0] for name in set(os.listdir(folder)) - before] == ["scored"]
        found.append(sorted(scored.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"])))
    assert len(found[0]) == len(rows)
    for one, other in zip(*found, strict=True):
        assert one[:5] == other[:5] and one[5:] == pytest.approx(other[5:])
