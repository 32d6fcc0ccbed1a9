"""Strict reading of model replies.

A reply is read once into a variant, which keeps the JSON types: a number where a text is due, or a
missing key, is then visible instead of being turned into text or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelode.functions.text import strip_fence

REQUIRED = ("name", "source_code", "purpose")
OPTIONAL = ("md5", "lang", "file", "code_type")


def _kind(value: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))


def _sealed(text: Column) -> Column:
    """Parse ``text`` inside an object that ends with its md5; anything after the reply breaks that."""
    seal = F.md5(text)
    whole = F.try_parse_json(F.concat(F.lit('{"reply":'), text, F.lit(',"seal":"'), seal, F.lit('"}')))
    return F.when(F.try_variant_get(whole, "$.seal", "string") == seal, whole)


def _entries_ok(entries: Column, required: tuple[str, ...], optional: tuple[str, ...]) -> Column:
    def entry_ok(entry: Column) -> Column:
        ok = F.lit(True)
        for key in required:
            ok = ok & (_kind(entry, f"$.{key}") == "STRING")
        for key in optional:
            ok = ok & _kind(entry, f"$.{key}").isin("STRING", "VOID")
        return ok

    return F.forall(entries, entry_ok)


def _entries(entries: Column, keys: tuple[str, ...]) -> Column:
    return F.transform(
        entries,
        lambda e: F.struct(*[F.try_variant_get(e, f"$.{key}", "string").alias(key) for key in keys]),
    )


def _parse(df: DataFrame, raw: str, keys: tuple[str, ...], optional: tuple[str, ...], purpose: bool):
    classes = F.try_variant_get("_reply", "$.reply.classes", "array<variant>")
    functions = F.try_variant_get("_reply", "$.reply.functions", "array<variant>")
    opened = (
        df.withColumn("_reply", _sealed(strip_fence(F.col(raw))))
        .withColumn("_classes", classes)
        .withColumn("_functions", functions)
    )
    reasons = [F.when(F.col("_reply").isNull(), "not_json")]
    if purpose:
        reasons.append(F.when(_kind(F.col("_reply"), "$.reply.purpose") != "STRING", "bad_purpose"))
    for name in ("classes", "functions"):
        column = F.col(f"_{name}")
        reasons.append(F.when(column.isNull(), f"bad_{name}"))
        reasons.append(F.when(~_entries_ok(column, keys, optional), f"bad_{name}_entry"))
    held = keys if purpose else (*keys, *optional)
    fields = [_entries(F.col("_classes"), held).alias("classes")]
    fields.append(_entries(F.col("_functions"), held).alias("functions"))
    if purpose:
        text = F.try_variant_get("_reply", "$.reply.purpose", "string")
        fields.insert(0, text.alias("purpose"))
    return (
        opened.withColumn("reject", F.coalesce(*reasons))
        .withColumn("reply", F.when(F.col("reject").isNull(), F.struct(*fields)))
        .drop("_reply", "_classes", "_functions")
    )


def parse_reply(df: DataFrame, raw: str = "output") -> DataFrame:
    """Add ``reply`` (purpose, classes, functions) and ``reject`` (why the reply is unusable, or null)."""
    return _parse(df, raw, REQUIRED, OPTIONAL, purpose=True)


def parse_split_reply(df: DataFrame, raw: str = "output") -> DataFrame:
    """As ``parse_reply`` for replies without purposes; entries keep ``code_type``, null where not given."""
    return _parse(df, raw, ("name", "source_code"), ("code_type",), purpose=False)


def parse_route_reply(df: DataFrame, raw: str = "output") -> DataFrame:
    """Add ``related`` (array of ``file, reason`` in the reply's order) and ``reject``."""
    listed = F.try_variant_get("_reply", "$.reply.related_files", "array<variant>")
    opened = df.withColumn("_reply", _sealed(strip_fence(F.col(raw)))).withColumn("_files", listed)
    reject = F.coalesce(
        F.when(F.col("_reply").isNull(), "not_json"),
        F.when(F.col("_files").isNull(), "bad_related_files"),
        F.when(~_entries_ok(F.col("_files"), ("file", "reason"), ()), "bad_related_files_entry"),
    )
    related = F.when(F.col("reject").isNull(), _entries(F.col("_files"), ("file", "reason")))
    return opened.withColumn("reject", reject).withColumn("related", related).drop("_reply", "_files")
