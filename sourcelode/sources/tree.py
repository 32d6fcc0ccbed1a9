"""Source trees as DataFrames: a level-by-level walk whose listing and reading run in tasks.

The folders must be mounted on every executor. Corpora held elsewhere enter as any ``files`` table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelode.catalogs import IgnoreRules, extension_frame
from sourcelode.functions.text import decode_ok, decode_text, fingerprint
from sourcelode.operators.filters import ignored, known_extensions_only, rooted, tag_language
from sourcelode.session import checkpoint

LIST_ROWS = 10_000
#: Bytes of files that a task holds before it passes them on.
READ_BYTES = 4 * 1024 * 1024

ENTRIES = "project string, root string, rel_path string, name string, file string, is_dir boolean, problem string"


@dataclass
class TreeScan:
    """``files`` in the shape of ``schema.FILES``; ``problems`` lists what could not be walked."""

    files: DataFrame
    problems: DataFrame


def _writable(path: str) -> bool:
    try:
        path.encode("utf-8")
        return True
    except UnicodeEncodeError:
        return False


def _entry(entry: os.DirEntry, rel: str) -> tuple:
    """(rel_path, name, file, is_dir, problem) of one entry; its problem concerns no other entry."""
    below = f"{rel}/{entry.name}" if rel else entry.name
    if not _writable(entry.path):
        return "", os.fsencode(entry.path).decode("utf-8", "replace"), "", False, "name is not UTF-8"
    try:
        return below, entry.path, os.path.realpath(entry.path), entry.is_dir(), None
    except OSError as problem:
        return below, entry.path, entry.path, False, f"{type(problem).__name__}: {problem.strerror}"


def _list_folders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each folder, in bounded batches so that one huge folder still streams."""
    columns = [part.split()[0] for part in ENTRIES.split(", ")]
    rows: list[tuple] = []
    for frame in frames:
        for project, root, rel, folder in zip(frame["project"], frame["root"], frame["rel_path"], frame["name"]):
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        rows.append((project, root, *_entry(entry, rel)))
                        if len(rows) >= LIST_ROWS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
            except OSError as problem:
                rows.append((project, root, rel, folder, folder, True, f"{type(problem).__name__}: {problem.strerror}"))
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _read_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        held, size, start = [], 0, 0
        for i, path in enumerate(frame["file"]):
            try:
                with open(path, "rb") as handle:
                    held.append(handle.read())
                size += len(held[-1])
            except OSError:
                held.append(None)
            if size >= READ_BYTES:
                yield frame.iloc[start : i + 1].assign(bytes=held)
                held, size, start = [], 0, i + 1
        if held:
            yield frame.iloc[start:].assign(bytes=held)


def list_tree(spark: SparkSession, projects: DataFrame, rules: IgnoreRules | None = None) -> TreeScan:
    """Walk ``(project, root)`` rows. Each level is one Spark job over its folders.

    A rejected folder is not entered, and a folder reached twice through links is entered once.
    Rules that are paths, absolute or below the root, are compared with every entry's canonical path.
    """
    rules = rules or IgnoreRules()
    listed = rooted([*rules.directories, *rules.files])

    @F.pandas_udf("string")
    def real_path(path: pd.Series) -> pd.Series:
        return path.map(os.path.realpath)

    below = replace(rules, **{side: [w for w in getattr(rules, side) if not w.startswith("/")] for side in ("directories", "files")})
    canonical = spark.createDataFrame([(p,) for p in listed], "path string").select(real_path("path").alias("path"))
    barred = [row["path"] for row in canonical.collect()] if listed else []  # as many as the rules name

    inner = [w.strip("/") for w in (*below.directories, *below.files) if "/" in w]

    def rejected() -> Column:
        here = [F.lit(path) for path in barred] + [F.concat("root", F.lit(f"/{path}")) for path in inner]
        broken = ignored(F.col("rel_path"), below)
        return broken | F.col("file").isin(*here) if here else broken

    level = checkpoint(
        projects.select(
            "project", real_path("root").alias("root"), F.lit("").alias("rel_path"), F.col("root").alias("name"), real_path("root").alias("file")
        )
    )
    entered, found = [level.select("project", "file")], []
    while not level.isEmpty():
        spread = level.repartition("project", "file")
        entries = checkpoint(spread.mapInPandas(_list_folders, ENTRIES))
        kept = entries.where(F.col("problem").isNotNull() | ~rejected())
        found.append(kept)
        seen = reduce(DataFrame.unionByName, entered)
        folders = kept.where(F.col("is_dir") & F.col("problem").isNull())
        level = checkpoint(
            folders.join(seen, ["project", "file"], "left_anti")
            .groupBy("project", "file")
            .agg(F.min_by(F.struct("root", "rel_path", "name"), "name").alias("_first"))
            .select("project", "_first.root", "_first.rel_path", "_first.name", "file")
        )
        entered.append(level.select("project", "file"))
    if not found:
        found = [spark.createDataFrame([], ENTRIES)]
    every = reduce(DataFrame.unionByName, found)
    files = (
        every.where(~F.col("is_dir") & F.col("problem").isNull())
        .groupBy("project", "file")
        .agg(F.min_by(F.struct("rel_path", "name"), "name").alias("_first"))
        .select("project", "file", "_first.name", "_first.rel_path")
    )
    problems = every.where("problem is not null").select("project", F.col("name").alias("path"), "problem")
    return TreeScan(files, problems)


def scan_files(
    spark: SparkSession,
    projects: DataFrame,
    rules: IgnoreRules | None = None,
    extensions: DataFrame | None = None,
    partitions: int | None = None,
) -> TreeScan:
    """List, filter, tag and read: one row per file with its text and fingerprint.

    Reading is spread by file, so neither a large folder nor a large project sits in one task.
    """
    extensions = extension_frame(spark) if extensions is None else extensions
    listing = list_tree(spark, projects, rules)
    wanted = tag_language(known_extensions_only(listing.files, extensions), extensions)
    shape = "project string, file string, name string, rel_path string, lang string"
    columns = [part.split()[0] for part in shape.split(", ")]
    spread = [F.col("project"), F.col("file")]
    even = wanted.repartition(partitions, *spread) if partitions else wanted.repartition(*spread)
    read = even.select(*columns).mapInPandas(_read_files, shape + ", bytes binary")
    files = read.select(
        *columns,
        decode_text(F.col("bytes")).alias("text"),
        decode_ok(F.col("bytes")).alias("decode_ok"),
    ).withColumn("md5", fingerprint(F.col("text")))
    return TreeScan(files, listing.problems)
