"""Whole jobs: build, refresh, summarise, ask."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.functions import prompts
from sourcelode.functions.replies import parse_reply, parse_route_reply
from sourcelode.functions.text import compose_content, html_unescape
from sourcelode.operators.changes import drop_summary, missing_files
from sourcelode.operators.chunks import pack_lines, pool_chunks
from sourcelode.operators.digest import PART_BYTES, project_digest, token_usage
from sourcelode.operators.entities import explode_entities, with_content
from sourcelode.operators.knn import fetch, knn
from sourcelode.operators.models import EMBEDDING_TYPE, Calls, Ledger, Model, run_model
from sourcelode.schema import FILE_KEY, INDEX, ROW_KEY, SUMMARY_FILE, SUMMARY_NAME
from sourcelode.session import broadcast_if_small, checkpoint, lasting, scratch
from sourcelode.sources.index_table import IndexTable

TOO_LONG = "maximum context length"


@dataclass(frozen=True)
class Models:
    """The pluggable calls and how they are made."""

    analyse: Model
    embed: Model
    summarise: Model
    answer: Model
    dim: int
    route: Model | None = None
    language: str = "English"
    split_when: str = "bytes"
    pooling: str = "window"
    partitions: int | None = None
    part_bytes: int = PART_BYTES
    calls: Calls = Calls()
    ledger: Ledger | None = None

    def call(self, df: DataFrame, stage: str, *names: str, **how) -> DataFrame:
        """Run the model of a stage, past the ledger where there is one."""
        how |= {"calls": self.calls, "partitions": how.get("partitions", self.partitions)}
        model = getattr(self, stage)
        return self.ledger.run_model(df, stage, model, *names, **how) if self.ledger else run_model(df, model, *names, **how)


@dataclass
class Built:
    """``rows`` to index and their ``purposes``, both lazy; ``rejects`` set aside (project, file, stage,
    reason); ``files`` with ``ok``."""

    rows: DataFrame
    purposes: DataFrame
    rejects: DataFrame
    files: DataFrame


@dataclass
class Refreshed:
    """What a job did. ``unsummarised`` (project, n_failed): projects whose summary was not made anew,
    because some of their files failed."""

    changed: int = 0
    removed: int = 0
    rejects: DataFrame | None = None
    usage: DataFrame | None = None
    unsummarised: DataFrame | None = None


def embed_texts(df: DataFrame, key: list[str], text: str, models: Models) -> DataFrame:
    """``(*key, embedding, n_chunks, embed_tokens, error)`` for texts of any length.

    ``split_when='bytes'`` packs every text, where a short one is its own only chunk.
    ``'rejected'`` embeds texts whole and packs only those the model calls too long.
    """
    wanted = df.select(*key, F.col(text).alias("chunk"))

    def in_chunks(texts: DataFrame) -> DataFrame:
        packed = pack_lines(texts, "chunk")
        # Spread by chunk: the chunks of one huge text must not stay in one task.
        spread = packed.repartition(*([models.partitions] if models.partitions else []), *key, "chunk_no")
        called = models.call(spread, "embed", "chunk", "vector", output_type=EMBEDDING_TYPE, partitions=None)
        return pool_chunks(checkpoint(called), key, models.dim, models.pooling)

    if models.split_when == "bytes":
        return in_chunks(wanted)
    if models.split_when != "rejected":
        raise ValueError(f"unknown split_when: {models.split_when}")
    whole = wanted.withColumn("chunk_no", F.lit(0)).withColumn("n_chunks", F.lit(1))
    called = checkpoint(models.call(whole, "embed", "chunk", "vector", output_type=EMBEDDING_TYPE, keep_prompt=True))
    too_long = F.coalesce(F.contains("error", F.lit(TOO_LONG)), F.lit(False))
    short = pool_chunks(called.where(~too_long), key, models.dim, models.pooling)
    return short.unionByName(in_chunks(called.where(too_long).select(*key, "chunk")))


def analyse(files: DataFrame, models: Models) -> DataFrame:
    """Ask for each file's description: ``files`` plus ``output, analysis_tokens, error``. Lazy."""
    asked = files.withColumn("prompt", prompts.analyse_prompt(F.col("lang"), F.col("text"), models.language))
    called = models.call(asked, "analyse")
    return called.withColumnRenamed("tokens", "analysis_tokens")


def build_entities(files: DataFrame, models: Models) -> Built:
    """Files to index rows. A file with any failed step is set aside whole, so none is half indexed.

    Only what models said is written down: the texts once, beside their replies, and the vectors
    without any text. Contents are composed again wherever they are needed.
    """
    wanted = files.select(*FILE_KEY, "name", "lang", "md5", "text", "decode_ok")
    described = checkpoint(parse_reply(analyse(wanted, models)).drop("output"), "described")
    failed = F.coalesce("error", "reject")
    entities = with_content(explode_entities(described.where(failed.isNull()).drop("error"))).withColumn(
        "analysis_tokens", F.when(F.col("kind_rank") == 0, F.col("analysis_tokens")).otherwise(F.lit(0).cast("long"))
    )
    vectors = checkpoint(embed_texts(entities, ROW_KEY, "content", models), "vectors")

    stage = F.when(F.col("error").isNotNull(), "analyse").otherwise("parse")
    rejects = described.where(failed.isNotNull()).select(*FILE_KEY, stage.alias("stage"), failed.alias("reason"))
    unembedded = vectors.where("error is not null").groupBy(*FILE_KEY).agg(F.min("error").alias("reason"))
    rejects = rejects.unionByName(unembedded.select(*FILE_KEY, F.lit("embed").alias("stage"), "reason"))
    with lasting():
        rejects = checkpoint(rejects, "rejects")
    bad = broadcast_if_small(rejects.select(*FILE_KEY).distinct())
    good = entities.join(bad, FILE_KEY, "left_anti")
    done = described.select(*FILE_KEY).join(bad.withColumn("_bad", F.lit(True)), FILE_KEY, "left")
    status = checkpoint(done.select(*FILE_KEY, F.col("_bad").isNull().alias("ok")), "status")
    return Built(good.join(vectors.drop("error"), ROW_KEY), good.select(*ROW_KEY, "purpose"), rejects, status)


def summarise(rows: DataFrame, models: Models) -> DataFrame:
    """``(project, summary, tokens, error)``: one per project, whatever its size.

    A digest of several parts is summed up part by part and the results once more, until one is left.
    """
    rows = rows.select("project", "file", "kind_rank", "ord", "purpose")
    finished = []
    while True:
        parts = project_digest(rows, models.part_bytes)
        asked = parts.select("project", "part_no", "n_parts", prompts.summary_prompt(F.col("digest"), models.language).alias("prompt"))
        called = models.call(asked, "summarise")
        said = checkpoint(called.withColumn("summary", html_unescape("output")).drop("output"))
        finished.append(said.select("project", F.when(F.col("n_parts") == 1, F.col("summary")).alias("summary"), "tokens", "error"))
        open_parts = said.where("n_parts > 1 and error is null")
        if open_parts.isEmpty():
            break
        rows = open_parts.select(
            "project",
            F.concat(F.lit("part "), F.lpad(F.col("part_no").cast("string"), 12, "0")).alias("file"),
            F.lit(0).alias("kind_rank"),
            F.lit(0).alias("ord"),
            F.col("summary").alias("purpose"),
        )
    every = reduce(DataFrame.unionByName, finished)
    return (
        every.groupBy("project")
        .agg(F.max("summary").alias("summary"), F.sum("tokens").alias("tokens"), F.min("error").alias("error"))
        .withColumn("summary", F.when(F.col("error").isNull(), F.col("summary")))
    )


def summary_rows(rows: DataFrame, models: Models) -> DataFrame:
    """The ``whole project`` row of each project, ready to index. ``rows`` must hold no old ones."""
    said = summarise(rows, models).where("error is null")
    purpose = F.col("summary")
    file, kind, name = F.lit(SUMMARY_FILE), F.lit("file"), F.lit(SUMMARY_NAME)
    shaped = said.select(
        "project",
        file.alias("file"),
        F.lit("").alias("md5"),
        kind.alias("code_type"),
        F.lit("").alias("lang"),
        name.alias("name"),
        purpose.alias("purpose"),
        compose_content(file, kind, name, purpose, F.lit("")).alias("content"),
        F.lit(0).alias("kind_rank"),
        F.lit(0).alias("ord"),
        F.lit(True).alias("decode_ok"),
    )
    shaped = checkpoint(shaped)
    vectors = embed_texts(shaped, ROW_KEY, "content", models).where("error is null")
    return shaped.join(vectors.drop("error", "embed_tokens"), ROW_KEY).select(*INDEX.fieldNames())


def upsert_summary(rows: DataFrame, models: Models) -> DataFrame:
    """Index rows with every project's summary row rebuilt."""
    plain = drop_summary(rows)
    return plain.unionByName(summary_rows(plain, models))


def latest_files(files: DataFrame) -> DataFrame:
    """One row per ``(project, file)``: the latest by ``seen_at`` where there is such a column.

    Repeats are looked for on narrow columns; texts move only for files that are repeated.
    """
    version = F.struct(*[c for c in ("seen_at", "md5") if c in files.columns])
    repeats = (
        files.groupBy(*FILE_KEY)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(version).alias("_last"))
        .where("_n > 1")
        .drop("_n")
    )
    repeats = checkpoint(repeats)
    if repeats.isEmpty():
        return files
    repeats = broadcast_if_small(repeats)
    once = files.join(repeats, FILE_KEY, "left_anti")
    again = files.join(repeats, FILE_KEY).where(version == F.col("_last")).drop("_last").dropDuplicates(FILE_KEY)
    return once.unionByName(again)


def rebuild_index(index: IndexTable, files: DataFrame, models: Models) -> Refreshed:
    """Clear the index and build it anew from ``files``."""
    with scratch(index.spark):
        built = build_entities(latest_files(files), models)
        summaries = summary_rows(_complete(built.purposes, built.files), models)
        index.overwrite(built.rows.select(*INDEX.fieldNames()).unionByName(summaries))
        return _report(built, built.files.count(), 0)


def _report(built: Built, changed: int, removed: int) -> Refreshed:
    failed = built.files.where(~F.col("ok")).groupBy("project").agg(F.count(F.lit(1)).alias("n_failed"))
    with lasting():
        usage, failed = checkpoint(token_usage(built.rows), "usage"), checkpoint(failed, "unsummarised")
    return Refreshed(changed, removed, built.rejects, usage, failed)


def refresh_index(
    index: IndexTable, files: DataFrame, models: Models, prune: bool = False, compact_after: int | None = 32
) -> Refreshed:
    """Bring the index up to date with ``files``; nothing is written when nothing changed.

    Only changed files are analysed, and only their rows and the summaries of their projects are
    written, as one delta. Rows of files no longer listed stay unless ``prune``. After
    ``compact_after`` deltas the index is compacted (never when None).
    """
    with scratch(index.spark):
        report = _refresh(index, files, models, prune)
    if report.changed + report.removed and compact_after and len(index.live()) > compact_after:
        index.compact()
    return report


def _refresh(index: IndexTable, files: DataFrame, models: Models, prune: bool) -> Refreshed:
    files = latest_files(files)
    keys = files.select(*FILE_KEY, "md5")
    held = index.rows()
    changed = checkpoint(index.changed(keys), "changed")
    n_changed = changed.count()
    gone = checkpoint(missing_files(held, keys), "gone") if prune else None
    n_gone = gone.count() if prune else 0
    if n_changed + n_gone == 0:
        return Refreshed()

    wanted = files.join(broadcast_if_small(changed), [*FILE_KEY, "md5"], "left_semi")
    built = build_entities(wanted, models)
    replaced = built.files.where("ok").select(*FILE_KEY)
    status = built.files
    if prune:
        replaced = replaced.unionByName(gone)
        status = status.unionByName(gone.withColumn("ok", F.lit(True)))
    touched = broadcast_if_small(status.select("project").distinct())
    kept = drop_summary(held.select(*ROW_KEY, "purpose")).join(touched, "project", "left_semi")
    kept = kept.join(broadcast_if_small(replaced), FILE_KEY, "left_anti")
    state = kept.unionByName(built.purposes)
    summaries = checkpoint(summary_rows(_complete(state, status), models), "summaries")

    old = replaced.unionByName(summaries.select(*FILE_KEY))
    if prune:
        # A project that lost its last file loses its summary row as well.
        empty = touched.join(state.select("project").distinct(), "project", "left_anti")
        old = old.unionByName(empty.select("project", F.lit(SUMMARY_FILE).alias("file")))
    index.replace(built.rows.select(*INDEX.fieldNames()).unionByName(summaries), old)
    return _report(built, n_changed, n_gone)


def _complete(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of the projects in which every file went through; the others keep their old summary."""
    unfinished = status.where(~F.col("ok")).select("project").distinct()
    return rows.join(broadcast_if_small(unfinished), "project", "left_anti")


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    models: Models,
    key: list[str],
    content: str | list[str] = "content",
    k: int = 10,
    scope: str | None = None,
) -> DataFrame:
    """``(query_id, query, embed_tokens, error, rank, *key, dist, content)`` for ``queries(query_id, query)``.

    ``content`` names one or more columns of the corpus.

    A query without hits, or whose embedding failed, has one row with null from ``rank`` on.
    """
    asked = queries.select("query_id", "query", *([scope] if scope else []))
    called = models.call(asked, "embed", "query", "embedding", output_type=EMBEDDING_TYPE, keep_prompt=True)
    called = checkpoint(called)
    hits = knn(corpus, called.where("error is null"), key, "query_id", models.dim, k, scope=scope)
    found = fetch(hits, corpus, key, [content] if isinstance(content, str) else content)
    every = called.select("query_id", "query", F.col("tokens").alias("embed_tokens"), "error")
    return every.join(found, "query_id", "left")


def ask(
    corpus: DataFrame,
    queries: DataFrame,
    models: Models,
    key: list[str] | None = None,
    content: str = "content",
    k: int = 10,
    scope: str | None = None,
) -> DataFrame:
    """``(query_id, n_hits, output, tokens, error)``: retrieve, build one prompt per query, answer.

    A query whose embedding failed is not answered and keeps that error; one without hits is asked
    with no contents.
    """
    found = checkpoint(retrieve(corpus, queries, models, key or ROW_KEY, content, k, scope))
    asked = gather_contents(found.where("error is null"), content).select(
        "query_id", "n_hits", prompts.ask_prompt(F.col("query"), F.col("contents"), models.language).alias("prompt")
    )
    answered = models.call(asked, "answer")
    failed = found.where("error is not null").select("query_id", F.lit(0).cast("long").alias("n_hits"), "error")
    return answered.unionByName(failed, allowMissingColumns=True)


def gather_contents(found: DataFrame, content: str = "content") -> DataFrame:
    """One row per query with its contents in rank order; k rows per group at most."""
    hit = F.when(F.col("rank").isNotNull(), F.struct("rank", F.col(content).alias("_text")))
    return found.groupBy("query_id").agg(
        F.first("query").alias("query"),
        F.count("rank").alias("n_hits"),
        F.transform(F.array_sort(F.collect_list(hit)), lambda row: row["_text"]).alias("contents"),
    )


def routed_ask(
    index: DataFrame, queries: DataFrame, models: Models, max_files: int = 5, k: int = 10, scope: str | None = None
) -> DataFrame:
    """``(query_id, n_files, n_unknown, output, tokens, error)``: ask in two steps.

    The k nearest entities of a query are offered to the routing model by file, name and purpose; of
    the files that its reply names, those on offer count, once each, in its order, up to
    ``max_files``, and the query is answered from their file rows. ``n_unknown`` counts named files
    that were not on offer. A query whose embedding, routing or reply failed is not answered and says why.
    """
    if models.route is None:
        raise ValueError("routing needs a model")
    offer = ["name", "purpose"]
    found = checkpoint(retrieve(index, queries, models, ROW_KEY, offer, k, scope), "offered")
    row = F.when(F.col("rank").isNotNull(), F.struct("rank", *FILE_KEY, *offer))
    offered = found.where("error is null").groupBy("query_id").agg(
        F.first("query").alias("query"), F.array_sort(F.collect_list(row)).alias("offered")
    )
    prompt = prompts.route_prompt(F.col("query"), F.col("offered"), max_files, models.language)
    routed = models.call(offered.withColumn("prompt", prompt), "route").withColumnRenamed("tokens", "route_tokens")
    routed = checkpoint(parse_route_reply(routed).withColumn("error", F.coalesce("error", "reject")), "routed")

    named = F.array_distinct(F.col("related.file"))
    known = F.filter(named, lambda f: F.array_contains("offered.file", f))
    chosen = F.transform(
        F.slice(known, 1, max_files),
        lambda f, n: F.struct(n.alias("place"), F.filter("offered", lambda o: o["file"] == f)[0].alias("row")),
    )
    good = routed.where("error is null").select(
        "query_id", "query", chosen.alias("chosen"), (F.size(named) - F.size(known)).cast("long").alias("n_unknown")
    )
    wanted = good.select("query_id", F.inline("chosen")).select("query_id", "place", "row.project", "row.file")
    wanted = checkpoint(wanted, "wanted")
    texts = index.where("kind_rank = 0").select(*FILE_KEY, "content")
    fetched = texts.join(broadcast_if_small(wanted), FILE_KEY)
    contents = fetched.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("rows"))
    texts_of = F.coalesce(F.col("rows.content"), F.array().cast("array<string>"))
    asked = good.join(contents, "query_id", "left").select(
        "query_id", F.size("chosen").cast("long").alias("n_files"), "n_unknown",
        prompts.ask_prompt(F.col("query"), texts_of, models.language).alias("prompt"),
    )
    answered = models.call(asked, "answer")
    failed = found.select("query_id", "error").unionByName(routed.select("query_id", "error")).where("error is not null")
    return answered.unionByName(failed, allowMissingColumns=True)
