"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelode.llm import fingerprint
from sourcelode.llm.bpe_tree import decode_tree, encode_tree
from sourcelode.llm.decontamination import with_contamination
from sourcelode.llm.embedding_dedup import near_duplicates
from sourcelode.llm.hard_negatives import mine_hard_negatives
from sourcelode.llm.line_dedup import dedup_lines
from sourcelode.llm.ngram_join import jaccard_groups
from sourcelode.llm.packing import encode_pieces, pack
from sourcelode.llm.recompression import with_runs
from sourcelode.llm.sharding import shard_rows
from sourcelode.llm.store import settled
from sourcelode.llm.suffix_tree_lm import score
from sourcelode.llm.text import slices, text_bytes
from sourcelode.llm.toxicity import train, with_toxicity
from sourcelode.llm.tokens import vocabulary
from sourcelode.llm.wavelet import read_documents, write_shards

Query = Callable[[SparkSession, str], DataFrame]

END_OF_DOCUMENT = 2
END_OF_TEXT = 0
SHARDS = 16
SEED = 2
TOXIC = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = fingerprint.with_next(documents, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, after = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
            edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after, strict=True)]
            own, changed, following = (
                fingerprint.digests(*text_bytes(pa.array(side, pa.large_string())))
                for side in (texts, edited, after)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array(own, pa.string()),
                    pa.array(changed, pa.string()),
                    pa.array(fingerprint.likeness(own, changed), pa.float64()),
                    pa.array(fingerprint.likeness(own, following), pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return paired.mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = encode_pieces(table(spark, sf_dir, "documents"), path, END_OF_DOCUMENT)
    return pack(settled(pieces, "pieces"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(documents, counts=True)


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches, "text"):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = encode_tree(words, text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4")).hexdigest())
                text_sha.append(hashlib.sha256(decode_tree(words, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(ids_sha, pa.string()),
                    pa.array(text_sha, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(rows, ["doc_id", "text_crc32", "size"], SHARDS, SEED)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


def crc_remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), F.coalesce(crc_remainder(10) == 0, F.lit(False)))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_documents(spark, write_shards(table(spark, sf_dir, "documents"), path, END_OF_TEXT))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_remainder(3) == 1, F.lit(False))
    classifier = train(documents, table(spark, sf_dir, "labels"), ~held_out)
    return with_toxicity(documents, classifier, "score").select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, chosen by its id, has its tail replaced by repeats of the tail's beginning."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    a = h // 10 % len(words)
    p = 1 + (len(words) - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + i % p] for i in range(len(words) - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_runs(documents, "r", key="doc_id", edit=repeated_words)
    line = F.transform("r.runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("r.runs").cast("long").alias("n_runs"), "r.greatest.start", "r.greatest.length",
        "r.greatest.period", F.expr("1000 * r.greatest.length div r.greatest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("r.collapsed", 256).alias("collapsed_sha256"),
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_contamination(documents, table(spark, sf_dir, "benchmark"), "c", size=10)
    return found.select(
        "doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"), (F.col("c.n_hit") > 0).alias("contaminated"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_fingerprint": op2_fingerprint,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe_tree": op5_bpe_tree,
    "op6_feistel_sharding": op6_feistel_sharding,
    "op7_ngram_join": op7_ngram_join,
    "op8_suffix_tree_lm": op8_suffix_tree_lm,
    "op9_wavelet_shards": op9_wavelet_shards,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontamination": op12_decontamination,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op1_embedding_dedup": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT l.vec_id AS a, r.vec_id AS b FROM usable l JOIN usable r
            ON l.vec_id <> r.vec_id AND len(l.v) = len(r.v) AND list_cosine_similarity(l.v, r.v) >= 0.95
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        )
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.least AS component_id, e.vec_id = c.least AS kept
        FROM embeddings e JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = e.vec_id
        LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
    """,
    "op7_ngram_join": r"""
        WITH RECURSIVE doc AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x{20}\x{09}-\x{0D}]+') AS w
            FROM documents
        ), shingle AS (
            SELECT DISTINCT row, array_to_string(w[s : s + 3], ' ') AS words
            FROM (SELECT row, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS s FROM doc WHERE len(w) > 0)
        ), size AS (
            SELECT row, count(*) AS n FROM shingle GROUP BY row
        ), shared AS (
            SELECT a.row AS x, b.row AS y, count(*) AS n FROM shingle a JOIN shingle b ON a.words = b.words AND a.row < b.row GROUP BY ALL
        ), link AS (
            SELECT d.doc_id AS a, e.doc_id AS b FROM shared JOIN size s ON s.row = x JOIN size t ON t.row = y
            JOIN doc d ON d.row = x JOIN doc e ON e.row = y WHERE 100 * shared.n >= 85 * (s.n + t.n - shared.n)
        ), edge AS (
            SELECT a, b FROM link UNION SELECT b, a FROM link
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
        )
        SELECT doc_id, coalesce(size.n, 0) AS n_shingles, least AS component_id
        FROM doc LEFT JOIN size USING (row) JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) ON a = doc_id
    """,
    "op12_decontamination": r"""
        WITH item AS (
            SELECT item_id, regexp_extract_all(replace_az, '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
            FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS replace_az
                  FROM benchmark WHERE item_id IS NOT NULL)
        ), win AS (
            SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS words
            FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)
        ), doc AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(replace_az, '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS replace_az FROM documents)
        ), place AS (
            SELECT row, size, s, array_to_string(w[s : s + size - 1], ' ') AS words
            FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS s
                  FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
        ), hit AS (
            SELECT row, item_id, s, size FROM place JOIN win USING (size, words)
        ), word AS (
            SELECT row, count(DISTINCT i) AS n FROM (SELECT row, unnest(range(s, s + size)) AS i FROM hit) GROUP BY row
        ), named AS (
            SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY row
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
               sha256(coalesce(named.items, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
        FROM doc LEFT JOIN word USING (row) LEFT JOIN named USING (row)
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
                   CAST(list_dot_product(a.e, r.e) AS BIGINT) AS score
            FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.e) = len(r.e)
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM s JOIN p USING (anchor_id)
        WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
}
