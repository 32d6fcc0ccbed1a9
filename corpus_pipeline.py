"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back
before the next one. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelode.llm.line_dedup import dedup_lines
from sourcelode.llm.ngram_join import jaccard_groups
from sourcelode.llm.packing import encode_pieces, pack
from sourcelode.llm.queries import END_OF_DOCUMENT, TOXIC, crc_remainder, table
from sourcelode.llm.store import free_name, settled
from sourcelode.llm.toxicity import train, with_toxicity
from sourcelode.session import broadcast_if_small


#: Rows that go to a Python worker at once. Texts may be long, and the stages share the workers.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Bound what executors hold of texts on their way to Python, for all that this session runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    small_batches(spark)
    held_out = F.coalesce(crc_remainder(3) == 1, F.lit(False))
    classifier = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    name = free_name(docs.columns, "toxicity")
    return with_toxicity(docs, classifier, name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one, and documents of which nothing else is left."""
    small_batches(spark)
    return dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies."""
    small_batches(spark)
    groups = jaccard_groups(docs.select("doc_id", "text"))
    copies = groups.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(broadcast_if_small(settled(copies, "copies")), "doc_id", "left_anti").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(settled(encode_pieces(docs, path, END_OF_DOCUMENT), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("best_fit_packing", pack_documents),
]

#: Model training, components and packing are beyond one SQL statement; a test compares the stages' results
#: with plain versions of what each has to keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
