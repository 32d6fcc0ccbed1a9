"""Change detection and row replacement, as joins on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.schema import FILE_KEY, SUMMARY_FILE


def changed_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files, new or altered, whose ``(project, file, md5)`` the index does not hold.

    A file always has its file row, so only those rows are read from the index.
    """
    held = index.where("kind_rank = 0").select(*FILE_KEY, "md5")
    return files.join(held, [*FILE_KEY, "md5"], "left_anti")


def delete_files(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys.select(*FILE_KEY), FILE_KEY, "left_anti")


def replace_by_file(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Drop what the index holds of the files in ``rows``, then add ``rows``."""
    return delete_files(index, rows).unionByName(rows)


def drop_summary(index: DataFrame) -> DataFrame:
    return index.where(F.col("file") != SUMMARY_FILE)


def clean_all(index: DataFrame) -> DataFrame:
    """Remove every row; the pattern meets the empty md5 of summary rows too."""
    return index.where(~F.col("md5").like("%"))


def missing_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """Keys that the index holds but the listing does not, summaries aside."""
    held = drop_summary(index).where("kind_rank = 0").select(*FILE_KEY).distinct()
    return held.join(files.select(*FILE_KEY), FILE_KEY, "left_anti")


def point_lookup(index: DataFrame, column: str, value: str, limit: int | None = None) -> DataFrame:
    """All columns of the rows with one value; with a limit, only the first ones in file order."""
    found = index.where(F.col(column) == value)
    return found if limit is None else found.orderBy("project", "file", "kind_rank", "ord").limit(limit)
