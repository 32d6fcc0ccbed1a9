"""A folder of source projects as a Spark data source: ``spark.read.format("source_tree")``.

Each folder right below ``path`` is a project. Planning walks the tree from the top, only until there
are ``folders`` pieces of work: what it has walked through are single folders, what it has not reached
are whole subtrees, folders with very many others in them are dealt out in shares by name, and tasks list
and read all of these. Rejected folders are never entered. A link that
leads to a place inside its own project is left to that place; other links are followed, and a subtree
is entered once per task. What can't be listed or read is a row with a ``problem``.

As a stream, a file belongs to the batch in whose span its change time lies, so a new or rewritten file
is seen once, and a file moved in by renaming as well; a whole folder moved in keeps its files' times
and is found by the next batch refresh instead. Files younger than ``lag`` seconds wait for the next batch.

The folder must be mounted on the driver and on every executor.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sourcelode.catalogs import IgnoreRules, extension_frame
from sourcelode.functions.text import decode_ok, decode_text, fingerprint
from sourcelode.operators.filters import known_extensions_only, rooted, tag_language
from sourcelode.schema import FILES

FORMAT = "source_tree"
FOLDERS = 256
LAG_SECONDS = 1.0
FOREVER = (0, 1 << 63)

SCHEMA = (
    T.StructType()
    .add("project", T.StringType())
    .add("rel_path", T.StringType())
    .add("name", T.StringType())
    .add("file", T.StringType())
    .add("changed", T.LongType())
    .add("bytes", T.BinaryType())
    .add("problem", T.StringType())
)


@dataclass
class Piece(InputPartition):
    """A folder of a project to read, or a share of it, with all below when ``deep``, for a span of change times."""

    project: str
    rel_path: str
    deep: bool
    span: tuple[int, int] = FOREVER
    #: Which of how many shares of the folder's own entries, dealt by their names.
    share: tuple[int, int] = (0, 1)


class Tree:
    """The walk itself: what lies in a folder once the rules have been asked."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.folders = int(options.get("folders", FOLDERS))
        self.lag = float(options.get("lag", LAG_SECONDS))
        rules = json.loads(options["rules"]) if "rules" in options else asdict(IgnoreRules())
        exact = [*rules["directories"], *rules["files"]]
        self.barred = {os.path.realpath(path) for path in rooted(exact)}
        below = [word for word in exact if not word.startswith("/")]
        self.names = {word for word in below if "/" not in word}
        self.paths = {word.strip("/") for word in below if "/" in word}
        self.prefixes = tuple(rules["directory_prefix"]) + tuple(rules["file_prefix"])
        self.suffixes = tuple(rules["directory_suffix"]) + tuple(rules["file_suffix"])

    def rejects(self, rel: str, name: str, real: str) -> bool:
        known = name in self.names or rel in self.paths or real in self.barred
        return known or name.startswith(self.prefixes) or name.endswith(self.suffixes)

    def scan(
        self, project: str, rel: str, share: tuple[int, int] = (0, 1)
    ) -> Iterator[tuple[str, str, str, bool, str | None]]:
        """(rel_path, path, canonical path, is a folder, problem) of what counts in a folder, or in a share of it."""
        home = os.path.realpath(os.path.join(self.root, project))
        folder = os.path.join(self.root, project, rel) if rel else os.path.join(self.root, project)
        try:
            entries = list(os.scandir(folder))
        except OSError as problem:
            if share[0] == 0:
                yield rel, folder, folder, True, f"{type(problem).__name__}: {problem.strerror}"
            return
        for entry in entries:
            if share[1] > 1 and zlib.crc32(os.fsencode(entry.name)) % share[1] != share[0]:
                continue
            below = f"{rel}/{entry.name}" if rel else entry.name
            try:
                entry.path.encode()
                real = os.path.realpath(entry.path)
                if self.rejects(below, entry.name, real) or (entry.is_symlink() and f"{real}/".startswith(f"{home}/")):
                    continue
                yield below, entry.path, real, entry.is_dir(), None
            except UnicodeEncodeError:
                yield "", os.fsencode(entry.path).decode("utf-8", "replace"), "", False, "name is not UTF-8"
            except OSError as problem:
                yield below, entry.path, entry.path, False, f"{type(problem).__name__}: {problem.strerror}"

    def plan(self, span: tuple[int, int] = FOREVER) -> list[Piece]:
        """Pieces of work: folders from the top down, whole subtrees once there are enough.

        A folder with more than ``folders`` folders in it is not walked through: tasks share its entries.
        """
        with os.scandir(self.root) as entries:
            waiting = deque((e.name, "") for e in entries if e.is_dir())
        pieces, wide = [], []
        while waiting and len(waiting) + len(pieces) + len(wide) < self.folders:
            project, rel = waiting.popleft()
            inside = (below for below, _, _, is_dir, problem in self.scan(project, rel) if is_dir and not problem)
            inside = list(islice(inside, self.folders + 1))
            if len(inside) > self.folders:
                wide.append((project, rel))
            else:
                pieces.append(Piece(project, rel, False, span))
                waiting.extend((project, below) for below in inside)
        pieces += [Piece(project, rel, True, span) for project, rel in waiting]
        shares = -(-self.folders // max(1, len(wide)))
        return pieces + [Piece(project, rel, True, span, (i, shares)) for project, rel in wide for i in range(shares)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        waiting, entered = [(piece.rel_path, piece.share)], set()
        while waiting:
            for rel, path, real, is_dir, problem in self.scan(piece.project, *waiting.pop()):
                if problem:
                    yield piece.project, rel, path, real, None, None, problem
                elif not is_dir:
                    yield from self._file(piece, rel, path, real)
                elif piece.deep and real not in entered:
                    entered.add(real)
                    waiting.append((rel, (0, 1)))

    @staticmethod
    def _file(piece: Piece, rel: str, path: str, real: str) -> Iterator[tuple]:
        try:
            changed = os.stat(real).st_ctime_ns
            if piece.span[0] < changed <= piece.span[1]:
                with open(real, "rb") as handle:
                    yield piece.project, rel, path, real, changed, handle.read(), None
        except OSError as problem:
            yield piece.project, rel, path, real, None, None, f"{type(problem).__name__}: {problem.strerror}"


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tree = Tree(options)

    def partitions(self) -> list[Piece]:
        return self.tree.plan()

    def read(self, partition: Piece) -> Iterator[tuple]:
        return self.tree.read(partition)


class TreeStreamReader(DataSourceStreamReader):
    """Offsets are change times in nanoseconds."""

    def __init__(self, options: dict[str, str]):
        self.tree = Tree(options)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.tree.lag * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.tree.plan((start["until"], end["until"]))

    def read(self, partition: Piece) -> Iterator[tuple]:
        return self.tree.read(partition)


class TreeSource(DataSource):
    """Options: ``path``; ``rules`` (JSON of the six lists); ``folders``; ``lag``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema: T.StructType) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def _options(path: str, rules: IgnoreRules | None, **more) -> dict[str, str]:
    lists = {kind: list(patterns) for kind, patterns in asdict(rules or IgnoreRules()).items()}
    return {"path": path, "rules": json.dumps(lists), **{k: str(v) for k, v in more.items() if v is not None}}


def source_files(found: DataFrame, extensions: DataFrame) -> DataFrame:
    """Rows of the source as ``schema.FILES`` plus ``rel_path`` and ``seen_at``; problems are left out."""
    wanted = tag_language(known_extensions_only(found.where("problem is null"), extensions), extensions)
    texts = wanted.withColumn("text", decode_text(F.col("bytes"))).withColumn("decode_ok", decode_ok(F.col("bytes")))
    named = texts.withColumn("md5", fingerprint(F.col("text"))).withColumnRenamed("changed", "seen_at")
    return named.select(*FILES.fieldNames(), "rel_path", "seen_at")


def read_tree(
    spark: SparkSession, path: str, rules: IgnoreRules | None = None, extensions: DataFrame | None = None,
    folders: int | None = None,
) -> DataFrame:
    """All files of the projects below ``path``, filtered, tagged and read."""
    spark.dataSource.register(TreeSource)
    found = spark.read.format(FORMAT).options(**_options(path, rules, folders=folders)).load()
    return source_files(found, extension_frame(spark) if extensions is None else extensions)


def stream_tree(
    spark: SparkSession, path: str, rules: IgnoreRules | None = None, extensions: DataFrame | None = None,
    folders: int | None = None, lag: float | None = None,
) -> DataFrame:
    """As ``read_tree``, as a stream of new and changed files."""
    spark.dataSource.register(TreeSource)
    found = spark.readStream.format(FORMAT).options(**_options(path, rules, folders=folders, lag=lag)).load()
    return source_files(found, extension_frame(spark) if extensions is None else extensions)
