"""Ordered project digests, whole but in parts of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.operators.position import with_running_sum

PART_BYTES = 256 * 1024


def project_digest(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(project, part_no, n_parts, n_lines, digest)``: lines ``file: purpose`` in row order.

    A project's lines, newlines counted, are laid end to end and cut every ``part_bytes``; a line
    belongs to the part in which it begins. A line counts for half a part at the most, so every part
    but the last has two lines at least and no number is left out. Joined with newlines in order the
    parts are the full digest. The bytes before each line come from a distributed running sum, so no
    task ever sees more of a project than one part. Rows without a project are left out.
    """
    if part_bytes < 2:
        raise ValueError("a part must hold two lines at least, or summing up parts never ends")
    order = ["file", "kind_rank", "ord"]
    line = F.concat("file", F.lit(": "), "purpose")
    lines = rows.where("project is not null").select("project", *order, line.alias("line"))
    size = F.least(F.coalesce(F.octet_length("line"), F.lit(0)) + 1, F.lit(part_bytes // 2))
    placed = with_running_sum(lines.withColumn("size", size.cast("long")), ["project"], [*order, "line"], "size")
    parts = placed.groupBy(
        "project",
        F.floor(F.col("before") / part_bytes).cast("long").alias("part_no"),
        (F.floor(F.col("last") / part_bytes) + 1).cast("long").alias("n_parts"),
    )
    gathered = parts.agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("before", "line"))).alias("_lines"))
    return gathered.withColumn("digest", F.array_join(F.col("_lines.line"), "\n")).drop("_lines")


def token_usage(entities: DataFrame) -> DataFrame:
    """Tokens per file: analysis is counted on the file row, embedding on every row."""
    return entities.groupBy("project", "file").agg(
        F.sum("analysis_tokens").alias("analysis_tokens"), F.sum("embed_tokens").alias("embed_tokens")
    )


def completion_gate(files: DataFrame, ok: str = "ok") -> DataFrame:
    """``(project, n_files, n_done, complete)``: a project is complete when all its files are done."""
    return files.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(ok).alias("n_done"),
        F.bool_and(ok).alias("complete"),
    )


def answer_count(hits: DataFrame, query_key: str) -> DataFrame:
    return hits.groupBy(query_key).agg(F.count(F.lit(1)).alias("n_answers"))
