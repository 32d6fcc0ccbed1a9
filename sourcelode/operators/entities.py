"""From parsed replies to file, class and function rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.functions.text import compose_content


def explode_entities(parsed: DataFrame) -> DataFrame:
    """One row for the file, one per class, one per function, tagged with the file's own columns.

    All three come from a single explode, so a model column upstream is evaluated once.
    ``parsed`` holds ``project, file, name, lang, md5, text`` and ``reply``.
    """

    def rows(kind: str, rank: int, entries: str):
        return F.transform(
            entries,
            lambda e, i: F.struct(
                F.lit(kind).alias("code_type"),
                e["name"].alias("name"),
                e["purpose"].alias("purpose"),
                e["source_code"].alias("source_code"),
                F.lit(rank).alias("kind_rank"),
                (i + 1).cast("int").alias("ord"),
            ),
        )

    whole = F.array(
        F.struct(
            F.lit("file").alias("code_type"),
            F.col("name"),
            F.col("reply.purpose").alias("purpose"),
            F.col("text").alias("source_code"),
            F.lit(0).alias("kind_rank"),
            F.lit(0).alias("ord"),
        )
    )
    every = F.concat(whole, rows("class", 1, "reply.classes"), rows("function", 2, "reply.functions"))
    kept = [c for c in parsed.columns if c not in ("name", "text", "reply", "reject")]
    return parsed.where(F.col("reply").isNotNull()).select(*kept, F.inline(every))


def with_content(entities: DataFrame) -> DataFrame:
    """Replace the source by the composed content, which is also what gets embedded."""
    content = compose_content(*[F.col(c) for c in ("file", "code_type", "name", "purpose", "source_code")])
    return entities.withColumn("content", content).drop("source_code")
