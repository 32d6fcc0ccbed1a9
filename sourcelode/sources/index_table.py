"""The index as a log of Parquet folders: a base, deltas with tombstones on top, and a commit log.

A write puts its rows, and the keys of the files it replaces or removes, into a folder of its own.
The last step is one row in ``log/version=n``, which makes the folder part of the table; a writer that
dies before it leaves the table as it was, and handles to older states keep reading their files.
A reader takes the last base and the later deltas and drops rows whose file a later tombstone names,
so a refresh costs what changed and not what is stored. ``compact`` writes a new base, ``vacuum``
deletes what no longer counts.

Beside each base lies a narrow table of file keys and fingerprints, bucketed by file, to which the
base and its deltas add theirs. Change detection joins a listing with it and never shuffles the index.

One writer at a time is expected. Of two that commit the same version the second one fails and may
try again on the new state.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelode.functions.vectors import vector_ok
from sourcelode.schema import FILE_KEY, INDEX
from sourcelode.session import broadcast_if_small, delete_folder, list_folders

STORED = T.StructType([*INDEX.fields, T.StructField("seq", T.LongType())])
KEYS = [*[INDEX[c] for c in (*FILE_KEY, "md5")], T.StructField("seq", T.LongType()), T.StructField("folder", T.StringType())]
GONE = T.StructType([*[INDEX[c] for c in FILE_KEY], T.StructField("seq", T.LongType())])
COMMIT = "kind string, folder string, n_gone bigint, keys string, buckets int"
BASE, DELTA = "base", "delta"
#: Files in one bucket of the key table when it is laid out.
BUCKET_FILES = 1_000_000


@dataclass(frozen=True)
class Commit:
    version: int
    kind: str
    folder: str
    n_gone: int
    keys: str
    buckets: int


@dataclass
class IndexTable:
    """``data/<folder>/rows`` and ``data/<folder>/gone`` hold what ``log/version=n`` makes count.

    ``buckets`` is the number of files that a base is written to; None leaves it to the data's size.
    """

    spark: SparkSession
    path: str
    dim: int
    buckets: int | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int, buckets: int | None = None) -> IndexTable:
        """Open the index, creating an empty one where there is none."""
        path = path.rstrip("/")
        held = _read(spark, "dim int", f"{path}/settings")
        held = held and held.first()
        if held is None:
            if _read(spark, COMMIT, f"{path}/log") is not None:
                raise ValueError(f"{path} holds rows but no settings; restore them, or create the index anew")
            return cls.create(spark, path, dim, buckets)
        if held["dim"] != dim:
            raise ValueError(f"the index holds vectors of {held['dim']} values, not {dim}")
        return cls(spark, path, dim, buckets)

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, buckets: int | None = None) -> IndexTable:
        """Create an empty index, replacing what is there."""
        table = cls(spark, path.rstrip("/"), dim, buckets)
        table.clear()
        settings = spark.createDataFrame([(dim,)], "dim int")
        settings.coalesce(1).write.mode("overwrite").parquet(f"{table.path}/settings")
        return table

    # ---- the log --------------------------------------------------------------------------------

    def log(self) -> list[Commit]:
        """All commits, oldest first: one row each, and ``vacuum`` drops those before the last base."""
        found = _read(self.spark, f"{COMMIT}, version bigint", f"{self.path}/log")
        rows = found.where("folder is not null").collect() if found is not None else []
        return sorted((Commit(*(r[f.name] for f in fields(Commit))) for r in rows), key=lambda c: c.version)

    def live(self) -> list[Commit]:
        """The last base and the deltas after it."""
        log = self.log()
        first = max((i for i, c in enumerate(log) if c.kind == BASE), default=0)
        return log[first:]

    def _commit(self, after: int, kind: str, folder: str, n_gone: int, keys: str, buckets: int) -> None:
        version = after + 1
        row = self.spark.createDataFrame([(kind, folder, n_gone, keys, buckets)], COMMIT).coalesce(1)
        while True:
            try:
                row.write.mode("error").parquet(f"{self.path}/log/version={version:012d}")
                return
            except AnalysisException as problem:
                if problem.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
            if any(c.version > after for c in self.log()):
                raise RuntimeError(f"another writer has changed {self.path} since version {after}")
            version += 1  # what a writer left that died while committing

    # ---- reading --------------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """All rows of the newest state, all columns. Later writes don't touch the files it reads."""
        return self._rows(self.live())

    def _rows(self, commits: list[Commit]) -> DataFrame:
        reader = self.spark.read
        stored = reader.schema(STORED).parquet(*[f"{self.path}/data/{c.folder}/rows" for c in commits])
        tombs = [f"{self.path}/data/{c.folder}/gone" for c in commits if c.kind == DELTA and c.n_gone]
        if tombs:
            gone = reader.schema(GONE).parquet(*tombs).groupBy(*FILE_KEY).agg(F.max("seq").alias("gone_seq"))
            later = (F.col("gone_seq").isNull()) | (F.col("seq") >= F.col("gone_seq"))
            stored = stored.join(broadcast_if_small(gone), FILE_KEY, "left").where(later)
        return stored.select(*INDEX.fieldNames())

    def _key_table(self, keys: str, buckets: int) -> str:
        """The name of a key table, made known to this session."""
        name = f"index_keys_{keys.replace('-', '_')}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in KEYS)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
            f" CLUSTERED BY ({', '.join(FILE_KEY)}) SORTED BY ({', '.join(FILE_KEY)}) INTO {buckets} BUCKETS"
            f" LOCATION '{_quoted(f'{self.path}/keys/{keys}')}'"
        )
        return name

    def fingerprints(self) -> DataFrame:
        """(project, file, md5) of every file in the newest state, from the key table; bucketed by file."""
        live = self.live()
        table = self._key_table(live[-1].keys, live[-1].buckets)
        self.spark.catalog.refreshTable(table)
        held = self.spark.table(table).where(F.col("folder").isin(*[c.folder for c in live]))
        last = F.max_by("md5", F.struct("seq", F.col("md5").isNotNull()))
        return held.groupBy(*FILE_KEY).agg(last.alias("md5")).where("md5 is not null")

    def changed(self, files: DataFrame) -> DataFrame:
        """The files (project, file, md5), new or altered, that the newest state doesn't hold."""
        held = self.fingerprints().withColumnRenamed("md5", "held_md5")
        return files.join(held, FILE_KEY, "left").where(~F.col("md5").eqNullSafe(F.col("held_md5"))).drop("held_md5")

    # ---- writing --------------------------------------------------------------------------------

    def check(self, rows: DataFrame) -> DataFrame:
        """Rows in index shape; a vector of the wrong width fails the write."""
        fine = vector_ok(F.col("embedding"), self.dim)
        width = F.when(fine, F.col("embedding")).otherwise(
            F.raise_error(F.concat(F.lit(f"not {self.dim} numbers: "), F.col("file"))).cast("array<float>")
        )
        shaped = rows.withColumn("embedding", width)
        return shaped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INDEX.fields])

    def _write(self, kind: str, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        log = self.log()
        after = log[-1].version if log else 0
        folder, seq = f"{after + 1:012d}-{uuid.uuid4().hex}", F.lit(after + 1).cast("long").alias("seq")
        place = f"{self.path}/data/{folder}"
        rows = self.spark.createDataFrame([], INDEX) if rows is None else rows
        rows.select("*", seq).write.parquet(f"{place}/rows")
        keys = self.spark.read.schema(STORED).parquet(f"{place}/rows").where("kind_rank = 0").select(*FILE_KEY, "md5", "seq")
        n_gone = 0
        if gone is not None:
            gone.select(*FILE_KEY).distinct().select("*", seq).write.parquet(f"{place}/gone")
            dropped = self.spark.read.schema(GONE).parquet(f"{place}/gone")
            n_gone = dropped.count()
            keys = keys.unionByName(dropped, allowMissingColumns=True)
        base = log[-1] if log and kind == DELTA else None
        held = (base.keys, base.buckets) if base else (folder, self.buckets or 1 << (keys.count() // BUCKET_FILES).bit_length())
        spread = keys.repartition(held[1], *FILE_KEY) if kind == BASE else keys.repartition(*FILE_KEY)
        writer = spread.withColumn("folder", F.lit(folder)).write.mode("append").bucketBy(held[1], *FILE_KEY)
        writer.sortBy(*FILE_KEY).saveAsTable(self._key_table(*held))
        self._commit(after, kind, folder, n_gone, *held)

    def append(self, rows: DataFrame) -> None:
        self._write(DELTA, self.check(rows))

    def overwrite(self, rows: DataFrame) -> None:
        """Replace everything. ``rows`` may read from this table: its files stay until ``vacuum``."""
        self._write(BASE, self._laid_out(self.check(rows)))

    def clear(self) -> None:
        self._write(BASE, None)

    def replace(self, rows: DataFrame, gone: DataFrame) -> None:
        """Delete the files of ``gone`` (project, file), then add ``rows``, in one commit.

        Only ``rows`` and the keys are written. A file whose old rows should go must be in ``gone``.
        """
        self._write(DELTA, self.check(rows), gone)

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        """A base lies sorted by file, so that a look at few files reads few row groups."""
        spread = rows.repartition(self.buckets, *FILE_KEY) if self.buckets else rows.hint("rebalance", *FILE_KEY)
        return spread.sortWithinPartitions(*FILE_KEY)

    def compact(self) -> None:
        """Write the newest state as a new base."""
        self._write(BASE, self._laid_out(self.rows()))

    def vacuum(self) -> int:
        """Delete folders that the newest state doesn't need, such as those of writers that died; how many.

        Handles to older states stop working, and so does a write under way.
        """
        live = self.live()
        kept = {c.folder for c in live}
        dropped = [f for f in list_folders(self.spark, f"{self.path}/data") if f not in kept]
        for folder in dropped:
            delete_folder(self.spark, f"{self.path}/data/{folder}")
        for keys in list_folders(self.spark, f"{self.path}/keys"):
            if keys != live[-1].keys:
                self.spark.sql(f"DROP TABLE IF EXISTS index_keys_{keys.replace('-', '_')}")
                delete_folder(self.spark, f"{self.path}/keys/{keys}")
        for commit in self.log():
            if commit.version < live[0].version:
                delete_folder(self.spark, f"{self.path}/log/version={commit.version:012d}")
        return len(dropped)


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is no such folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
