"""Source files, index snapshots and model replies derived from the given tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelode.catalogs import extension_frame
from sourcelode.functions import local_models
from sourcelode.operators.filters import tag_language
from sourcelode.plans.jobs import Models
from sourcelode.session import shared_dir

DIRS = ("src", "tests", "target", "lib", "docTest", "node_modules", "core", "pkg.egg-info")
STEMS = ("main", "test_x", "util", "README", "mod")
EXTS = (".py", ".rs", ".md", ".h", ".m", ".R", ".java", ".sh", "")

REPLY_TURNS = 8

LOCAL = Models(
    analyse=local_models.analyse,
    embed=local_models.embed,
    summarise=local_models.summarise,
    answer=local_models.answer,
    dim=local_models.LOCAL_DIM,
    route=local_models.route,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: Column, words: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (number % len(words) + 1).cast("int"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per document, spread over directories, stems and extensions."""
    n = F.col("doc_id")
    rel = F.concat(F.lit("m"), n.cast("string"), F.lit("/"), _pick(n, DIRS), F.lit("/"), _pick(n, STEMS), _pick(n, EXTS))
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project"), rel.alias("rel_path"), "text")
    path = F.concat(F.lit("/proj/"), "project", F.lit("/"), "rel_path")
    return files.withColumn("file", path).withColumn("name", path).withColumn("md5", F.md5("text"))


def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tag_language(source_files(spark, sf_dir), extension_frame(spark))
    return files.withColumn("decode_ok", F.lit(True))


def old_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the index: some files missing, some with another fingerprint."""
    return stored_rows(spark, sf_dir).where("doc_id % 10 <> 0")


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of every document, some with another fingerprint."""
    files = tagged_files(spark, sf_dir)
    old = F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit(" old")))).otherwise(F.col("md5"))
    numbered = files.withColumn("ord", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))
    return _index_rows(numbered.withColumn("md5", old))


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file rows of every file as it is now."""
    return _index_rows(tagged_files(spark, sf_dir).withColumn("ord", F.lit(0)))


def _index_rows(numbered: DataFrame) -> DataFrame:
    whole = F.col("ord") == 0
    return numbered.select(
        "doc_id",
        "project",
        "file",
        "md5",
        F.when(whole, "file").otherwise("class").alias("code_type"),
        "lang",
        F.when(whole, F.col("name")).otherwise(F.concat(F.lit("K"), F.col("ord").cast("string"))).alias("name"),
        F.concat(F.lit("about "), F.col("doc_id").cast("string"), F.lit("."), F.col("ord").cast("string")).alias("purpose"),
        F.when(whole, 0).otherwise(1).alias("kind_rank"),
        "ord",
        "decode_ok",
    )


def hex_vector(text: Column) -> Column:
    """The local embedding model as a column: the md5 digits as sixteenths."""
    digest = F.md5(text)
    return F.transform(
        F.sequence(F.lit(1), F.lit(local_models.LOCAL_DIM)),
        lambda i: ((F.instr(F.lit("0123456789abcdef"), F.substring(digest, i, F.lit(1))) - 1) / 16).cast("float"),
    )


def with_vectors(rows: DataFrame) -> DataFrame:
    """Index rows with their purpose as content, embedded."""
    return rows.withColumns(
        {"content": F.col("purpose"), "embedding": hex_vector(F.col("purpose")), "n_chunks": F.lit(1)}
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced JSON replies of at most eight turns: assistant turns as functions, all others as classes."""
    turns = table(spark, sf_dir, "conversations").withColumn("part", F.floor(F.col("turn") / REPLY_TURNS))

    assistant = F.col("role") == "assistant"

    def entries(wanted: Column, letter: str) -> Column:
        row = F.struct(
            "turn",
            F.concat(F.lit(letter), F.col("turn").cast("string")).alias("name"),
            F.col("text").alias("source_code"),
            F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("purpose"),
        )
        ordered = F.array_sort(F.collect_list(F.when(wanted, row)))
        return F.transform(ordered, lambda r: F.struct(r["name"], r["source_code"], r["purpose"]))

    grouped = turns.groupBy("conv_id", "part").agg(
        entries(~assistant, "c").alias("classes"), entries(assistant, "f").alias("functions")
    )
    purpose = F.concat(F.lit("p"), F.col("conv_id").cast("string"))
    body = F.to_json(F.struct(purpose.alias("purpose"), "classes", "functions"))
    split = F.to_json(F.struct("classes", "functions"))
    number = F.col("conv_id").cast("string")
    return grouped.select(
        "conv_id",
        F.col("part").cast("long").alias("part"),
        F.concat(F.lit("conv"), (F.col("conv_id") % 5).cast("string")).alias("project"),
        F.concat(F.lit("/conv/c"), number, F.lit("/p"), F.col("part").cast("string"), F.lit(".py")).alias("file"),
        body.alias("body"),
        split.alias("split_body"),
        F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("raw"),
    )


def damaged_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies again, most of them damaged in a way that follows from ``conv_id``."""
    n = F.col("conv_id") % 10
    body = F.col("body")
    opened = F.expr("substr(body, 1, length(body) - 1)")
    damaged = (
        F.when(n == 0, F.regexp_replace(body, '"classes":', '"klasses":'))
        .when(n == 1, F.concat(opened, F.lit(',"functions2":[]} and more')))
        .when(n == 2, F.lit("no description"))
        .when(n == 3, F.regexp_replace(body, r'^\{"purpose":"p', '{"purpose":1,"was":"p'))
        .when(n == 4, F.concat(opened, F.lit(',"extra":{"a":[1]}}')))
        .when(n == 5, F.concat(opened, F.lit(",}")))
        .when(n == 6, body)
        .when(n == 7, F.regexp_replace(body, '"functions":\\[', '"functions":[{"name":"x","purpose":"y"},'))
        .when(n == 8, F.regexp_replace(body, '"functions":\\[', '"functions":[{"name":"x","purpose":"y","source_code":7},'))
        .otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    )
    # An empty list would leave a trailing comma behind the entries put in above.
    return replies(spark, sf_dir).withColumn("raw", F.regexp_replace(damaged, "\\},\\]\\}$", "}]}"))


def write_tree(spark: SparkSession, files: DataFrame, root: str) -> None:
    """Write ``(project, rel_path, bytes)`` rows as files below ``root/project``."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for project, rel, data in zip(frame["project"], frame["rel_path"], frame["bytes"]):
                path = Path(root, project, rel)
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(data)
            yield pd.DataFrame({"n": [len(frame)]})

    files.select("project", "rel_path", "bytes").mapInPandas(task, "n long").agg(F.sum("n")).collect()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder as a mounted path, for files that are no tables."""
    path = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise RuntimeError(f"{path} is not a mounted folder")
    return os.path.join(path)
