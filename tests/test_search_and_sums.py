import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcelode.functions.text import CHUNK_BYTES, cut_points
from sourcelode.operators import knn as search
from sourcelode.operators.chunks import pack_lines, pool_chunks
from sourcelode.operators.digest import project_digest
from sourcelode.operators.position import with_running_sum


def vectors(n, dim=6, seed=1):
    pick = np.random.default_rng(seed)
    return [(i, f"s{i % 3}", [float(x) for x in pick.integers(-3, 4, dim)]) for i in range(n)]


def brute(corpus, queries, k, scope):
    found = []
    for q, name, v in queries:
        near = [(sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, own, w in corpus if not scope or own == name]
        found += [(q, rank, i, d) for rank, (d, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("scope", [None, "scope"])
@pytest.mark.parametrize("block_bytes", [1 << 20, 1200])
def test_knn_equals_brute_force_with_ties(spark, scope, block_bytes):
    schema = "id bigint, scope string, embedding array<float>"
    rows, asked = vectors(600), vectors(40, seed=2)
    corpus = spark.createDataFrame([*rows, (900, "s1", None), (901, "s1", [1.0])], schema).repartition(9)
    queries = spark.createDataFrame([*asked, (41, "none", [0.0] * 6), (42, "s1", [float("nan")] * 6)], schema)
    queries = queries.withColumnRenamed("id", "query_id")
    found = search.knn(corpus, queries, ["id"], "query_id", 6, 5, scope=scope, block_bytes=block_bytes)
    wanted = brute(rows, [*asked, (41, "none", [0.0] * 6)], 5, scope)
    assert sorted((r["query_id"], r["rank"], r["id"], r["dist"]) for r in found.collect()) == wanted


def test_bounds_cut_what_tasks_pass_on_and_the_corpus_stays(spark):
    rows = vectors(6400, dim=4, seed=3)
    corpus = spark.createDataFrame(rows, "id bigint, scope string, _v array<float>").repartition(64)
    corpus.write.mode("overwrite").parquet(path := search.checkpoint(corpus).inputFiles()[0].rpartition("/")[0] + "-copy")
    corpus = spark.read.parquet(path).repartition(64)
    table = spark.createDataFrame([(i, v, None) for i, _, v in vectors(20, 4, 4)], "_id bigint, _qv array<float>, _scope string").toArrow()
    sent = search.Sent(spark.sparkContext.broadcast(table), 4, None, ["id"], 10)
    bounds = search.distance_bounds(corpus, sent, 20)
    free = search.nearest_per_task(corpus, sent, np.full(20, np.inf)).count()
    local = search.nearest_per_task(corpus, sent, bounds)
    assert np.isfinite(bounds).all() and free == 20 * 64 * 10 and local.count() < free / 4
    plan = search.nearest_per_task(spark.read.parquet(path), sent, bounds)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_knn_without_queries_or_corpus(spark):
    none = spark.createDataFrame([], "id bigint, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, embedding array<float>")
    for corpus, queries in ((none, some), (some, none), (none, none)):
        assert search.knn(corpus, queries.withColumnRenamed("id", "query_id"), ["id"], "query_id", 2).count() == 0


def test_large_ids_stay_whole_beside_a_null_one(spark):
    big = 2**53 + 1
    corpus = spark.createDataFrame([(None, [0.0]), (big, [1.0]), (big + 2, [2.0])], "id bigint, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0])], "query_id bigint, embedding array<float>")
    assert [r["id"] for r in search.knn(corpus, queries, ["id"], "query_id", 1).orderBy("rank").collect()] == [big, None, big + 2]


def brute_pool(chunks, dim, mode):
    flat, k = np.array(chunks, dtype=np.float64), len(chunks)
    slots = flat.reshape(dim, k).sum(axis=1) if mode == "window" else flat.sum(axis=0)
    return [float(np.float32(s / k)) for s in slots]


@pytest.mark.parametrize("mode", ["window", "mean"])
def test_pooling_has_the_same_bits_in_any_order(spark, mode):
    pick, texts = np.random.default_rng(5), {}
    for name, k in (("a", 1), ("b", 2), ("c", 7), ("d", 90)):
        texts[name] = (pick.normal(size=(k, 8)) * 10.0 ** pick.integers(-6, 6, size=(k, 8))).astype(np.float32)
    rows = [(t, n, len(v), [float(x) for x in row], 1, None) for t, v in texts.items() for n, row in enumerate(v)]
    rows += [("bad", 0, 2, [1.0] * 8, 1, None), ("bad", 1, 2, None, 1, "failed"), ("lost", 0, 3, [1.0] * 8, 1, None)]
    schema = "text string, chunk_no int, n_chunks int, vector array<float>, tokens bigint, error string"
    seen = set()
    for seed, partitions in ((1, 1), (2, 5), (3, 40)):
        random.Random(seed).shuffle(rows)
        pooled = pool_chunks(spark.createDataFrame(rows, schema).repartition(partitions), ["text"], 8, mode).collect()
        seen.add(str(sorted((r["text"], r["embedding"], r["n_chunks"], r["embed_tokens"], r["error"]) for r in pooled)))
    assert len(seen) == 1
    by_text = {r["text"]: r for r in pooled}
    for name, v in texts.items():
        assert np.allclose(by_text[name]["embedding"], brute_pool(v.tolist(), 8, mode), rtol=1e-6)
    assert by_text["bad"]["error"] == "failed" and by_text["lost"]["error"] == "missing_chunk"


def brute_digest(rows, part_bytes):
    parts, projects = [], {}
    for project, file, rank, ord_, purpose in rows:
        projects.setdefault(project, []).append((file, rank, ord_, f"{file}: {purpose}"))
    for project, lines in projects.items():
        before, numbered = 0, []
        for *_, line in sorted(lines):
            numbered.append((before // part_bytes, line))
            before += min(len(line.encode()) + 1, part_bytes // 2)
        last = numbered[-1][0]
        for part in range(last + 1):
            own = [line for n, line in numbered if n == part]
            parts.append((project, part, last + 1, len(own), "\n".join(own)))
    return sorted(parts)


@pytest.mark.parametrize("part_bytes", [2, 50, 333, 1 << 20])
def test_digest_parts_equal_brute_force(spark, part_bytes):
    pick = random.Random(6)
    rows = [(f"p{min(pick.randint(0, 9), 3)}", f"f{pick.randint(0, 60)}", pick.randint(0, 2), n, "é" * pick.randint(0, 30)) for n in range(700)]
    frame = spark.createDataFrame(rows, "project string, file string, kind_rank int, ord int, purpose string").repartition(7)
    found = project_digest(frame, part_bytes).select("project", "part_no", "n_parts", "n_lines", "digest")
    assert sorted(map(tuple, found.collect())) == brute_digest(rows, part_bytes)


def test_running_sums_cross_partitions_and_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(("hot" if n % 3 else f"g{n % 5}"), n, n % 4) for n in range(900)]
    frame = spark.createDataFrame(rows, "g string, n int, w bigint").repartition(5)
    found = with_running_sum(frame, ["g"], ["n"], "w").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    for group in {r[0] for r in rows}:
        total, last = 0, max((sum(w for g, m, w in rows if g == group and m < n), n) for g, n, _ in rows if g == group)[0]
        for r in sorted((r for r in found if r["g"] == group), key=lambda r: r["n"]):
            assert (r["before"], r["last"]) == (total, last)
            total += r["w"]
    assert with_running_sum(frame.limit(0), ["g"], ["n"], "w").count() == 0


def brute_pack(text, limit):
    chunks, filled = [], 0
    for line in text.split("\n"):
        size = len(line.encode())
        if chunks and filled + size < limit:
            chunks[-1].append(line)
            filled += size
        else:
            chunks.append([line])
            filled = size
    return ["\n".join(c) for c in chunks]


def test_packing_equals_a_plain_loop_and_gives_the_text_back(spark):
    pick = random.Random(7)
    texts = ["\n".join("é" * pick.randint(0, 12) for _ in range(pick.randint(1, 40))) for _ in range(80)] + ["", "\n", "\n\n", "x" * 99]
    frame = spark.createDataFrame([*enumerate(texts), (999, None)], "id int, text string")
    packed = pack_lines(frame, limit=20).collect()
    for i, text in enumerate(texts):
        chunks = [r["chunk"] for r in sorted((r for r in packed if r["id"] == i), key=lambda r: r["chunk_no"])]
        assert chunks == brute_pack(text, 20) and "\n".join(chunks) == text
    assert {r["n_chunks"] for r in packed if r["id"] == 0} == {len(brute_pack(texts[0], 20))}
    assert not [r for r in packed if r["id"] == 999]


def test_lines_at_the_limit(spark):
    edge = "\n".join(["a" * (CHUNK_BYTES - 1), "", "b" * CHUNK_BYTES, "c"])
    packed = pack_lines(spark.createDataFrame([(edge,)], "text string")).orderBy("chunk_no").collect()
    assert [(len(r["chunk"]), r["oversize"]) for r in packed] == [(CHUNK_BYTES, False), (CHUNK_BYTES, True), (1, False)]


def test_a_text_with_very_many_chunks_is_packed_in_linear_time():
    cuts = cut_points(np.full(300_000, 5), np.array([0, 100_000, 100_000, 300_000]), 6)
    assert [len(c) for c in cuts] == [99_999, 0, 199_999]
