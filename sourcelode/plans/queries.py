"""One query per operator over the given tables. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelode import catalogs
from sourcelode.functions import local_models, prompts
from sourcelode.functions import text as text_columns
from sourcelode.functions.replies import parse_reply, parse_split_reply
from sourcelode.functions.vectors import vector_ok
from sourcelode.operators import changes, digest, filters
from sourcelode.operators.chunks import pack_lines, pool_chunks
from sourcelode.operators.entities import explode_entities, with_content
from sourcelode.operators.knn import knn
from sourcelode.operators.models import EMBEDDING_TYPE, run_model
from sourcelode.operators.position import with_running_sum
from sourcelode.plans import jobs
from sourcelode.plans.relations import (
    LOCAL,
    damaged_replies,
    new_rows,
    old_rows,
    stored_rows,
    replies,
    shared_folder,
    source_files,
    table,
    tagged_files,
    with_vectors,
    write_tree,
)
from sourcelode.schema import FILES, ROW_KEY, SUMMARY_FILE
from sourcelode.session import checkpoint, fresh_path
from sourcelode.sources import tree_source
from sourcelode.sources.index_table import IndexTable
from sourcelode.sources.tree import scan_files as scan_tree_files
from sourcelode.streaming.refresh import refresh_stream as start_refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RULES = catalogs.IgnoreRules()
PATH_RULES = ("src3", "src5/m25", "src7/m7/node_modules")
#: Relative and absolute paths as rules, beside one prefix and one suffix.
ROOTED_RULES = catalogs.IgnoreRules(
    directories=(*(f"m{n}/node_modules" for n in range(5, 400, 16)), *(f"/proj/src{n}/m{n}" for n in range(20))),
    directory_prefix=("core",), directory_suffix=(),
    files=(*(f"m{n}/target/README" for n in range(5)), "/proj/src8/m8/src/README", "m18/target/README.py"),
    file_prefix=(), file_suffix=(".java",),
)
LANGUAGE = LOCAL.language
DIGEST_BYTES = 4096
FILE_ROW = ["project", "file", "md5", "code_type", "lang", "name", "purpose"]


def query(fn: Query) -> Query:
    """Register a query under its name, less the underscore that keeps it apart from an import."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def vector_text(vector: Column) -> Column:
    """A vector as text of millionths, so that both engines compare the same digits."""
    parts = F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string"))
    return F.array_join(parts, ",")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("long") for name in names})


# ---- sources and sinks ----------------------------------------------------------------------


def damaged_bytes(text: Column, broken: Column) -> Column:
    """UTF-8 bytes, some with one byte that no UTF-8 text holds."""
    return F.when(broken, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(text, "UTF-8"))


@query
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = str(Path(shared_folder(spark), Path(fresh_path(spark, "tree")).name))
    files = source_files(spark, sf_dir)
    write_tree(spark, files.withColumn("bytes", damaged_bytes(F.col("text"), F.col("doc_id") % 7 == 0)), root)
    projects = files.select("project").distinct().withColumn("root", F.concat(F.lit(root + "/"), "project"))
    found = scan_tree_files(spark, projects, RULES).files
    return found.select("project", "rel_path", "lang", "md5", "decode_ok", F.octet_length("text").cast("long").alias("n_bytes"))


@query
def read_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree through the data source."""
    root = str(Path(shared_folder(spark), Path(fresh_path(spark, "tree")).name))
    files = source_files(spark, sf_dir)
    write_tree(spark, files.withColumn("bytes", damaged_bytes(F.col("text"), F.col("doc_id") % 7 == 0)), root)
    found = tree_source.read_tree(spark, root, RULES)
    return found.select("project", "rel_path", "lang", "md5", "decode_ok", F.octet_length("text").cast("long").alias("n_bytes"))


@query
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = table(spark, sf_dir, "documents").select(
        "doc_id", damaged_bytes(F.col("text"), F.col("doc_id") % 7 == 0).alias("bytes")
    )
    return content.select(
        "doc_id",
        text_columns.decode_text(F.col("bytes")).alias("text"),
        text_columns.decode_ok(F.col("bytes")).alias("decode_ok"),
    )


@query
def open_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "index")

    def state(step: str) -> DataFrame:
        rows = IndexTable.open(spark, path, LOCAL.dim).rows()
        counted = rows.agg(F.count(F.lit(1)).alias("n_rows"))
        return checkpoint(counted.select(F.lit(step).alias("step"), "n_rows", F.lit(len(rows.columns)).cast("long").alias("n_columns")))

    steps = [state("created")]
    IndexTable.open(spark, path, LOCAL.dim).append(with_vectors(new_rows(spark, sf_dir)))
    return reduce(DataFrame.unionByName, [*steps, state("opened")])


def _stored(spark: SparkSession, rows: DataFrame) -> IndexTable:
    index = IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim)
    index.append(with_vectors(rows))
    return index


@query
def append_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _stored(spark, old_rows(spark, sf_dir))
    index.append(with_vectors(new_rows(spark, sf_dir).where("doc_id % 10 = 0")))
    return longs(index.rows().select(*FILE_ROW, "kind_rank", "ord"), "kind_rank", "ord")


@query
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(spark, stored_rows(spark, sf_dir)).rows()
    return longs(rows.withColumn("embedding", vector_text(F.col("embedding"))), "kind_rank", "ord", "n_chunks")


@query
def ignore_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, with how many files meet each rule."""
    hits = filters.rule_hits(source_files(spark, sf_dir), RULES)
    counted = RULES.frame(spark).join(hits, ["kind", "pattern"], "left")
    return counted.withColumn("n_files", F.coalesce("n_files", F.lit(0)).cast("long"))


def _extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = text_columns.extension(F.col("name"))
    return source_files(spark, sf_dir).groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n_files"))


@query
def ext_catalog_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension to language, with how many files have it."""
    inverted = catalogs.invert(catalogs.language_frame(spark))
    counted = inverted.join(_extension_counts(spark, sf_dir), "ext", "left")
    return counted.withColumn("n_files", F.coalesce("n_files", F.lit(0)).cast("long"))


@query
def ext_catalog_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language to its extensions, with how many files it has."""
    extensions = catalogs.invert(catalogs.language_frame(spark))
    files = filters.tag_language(source_files(spark, sf_dir), extensions)
    counts = files.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n_files"))
    regrouped = catalogs.regroup(extensions).join(counts, "language", "left")
    return regrouped.select("language", F.array_join("exts", ",").alias("exts"), F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))


# ---- filters and projections ----------------------------------------------------------------


@query
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_ignore_rules(source_files(spark, sf_dir), RULES).select("project", "file")


@query
def ignore_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = source_files(spark, sf_dir).withColumn("below", F.concat("project", F.lit("/"), "rel_path"))
    return filters.apply_path_rules(below, PATH_RULES, "below").select("project", "file")


@query
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [ext for exts in catalogs.LANGUAGE_EXTENSIONS.values() for ext in exts]
    reason = filters.reject_reason(F.col("rel_path"), RULES, known)
    return source_files(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_files"))


@query
def reject_path_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons under rules of which most are paths, relative and absolute."""
    known = [ext for exts in catalogs.LANGUAGE_EXTENSIONS.values() for ext in exts]
    reason = filters.reject_reason(F.col("rel_path"), ROOTED_RULES, known, F.col("file"))
    return source_files(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_files"))


@query
def ignore_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left under rules of which most are paths, relative and absolute."""
    return filters.apply_ignore_rules(source_files(spark, sf_dir), ROOTED_RULES, absolute="file").select("project", "file")


@query
def ext_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = catalogs.extension_frame(spark)
    return filters.known_extensions_only(source_files(spark, sf_dir), known).select("project", "file")


@query
def file_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(spark, sf_dir).select("file", text_columns.extension(F.col("name")).alias("ext"))


@query
def tag_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.tag_language(source_files(spark, sf_dir), catalogs.extension_frame(spark)).select("file", "lang")


@query
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.point_lookup(stored_rows(spark, sf_dir), "code_type", "class")
    return longs(found.select(*FILE_ROW, "kind_rank", "ord"), "kind_rank", "ord")


@query
def delete_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = source_files(spark, sf_dir).where("doc_id % 13 = 0")
    return longs(changes.delete_files(stored_rows(spark, sf_dir), keys).select(*FILE_ROW, "ord"), "ord")


@query
def clean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_rows(spark, sf_dir)
    summaries = rows.select("project").distinct().withColumn("file", F.lit(SUMMARY_FILE)).withColumn("md5", F.lit(""))
    index = rows.select("project", "file", "md5").unionByName(summaries)

    def counted(state: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(state).alias("state"), "n_rows")

    return counted("before", index).unionByName(counted("after", changes.clean_all(index)))


@query
def compose_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tagged_files(spark, sf_dir)
    purpose = F.concat(F.lit("about "), F.col("doc_id").cast("string"))
    content = text_columns.compose_content(F.col("file"), F.lit("file"), F.col("name"), purpose, F.col("text"))
    return files.select("file", content.alias("content"))


# ---- changes --------------------------------------------------------------------------------


@query
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_columns.fingerprint(F.col("text")).alias("md5"))


@query
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir).select("project", "file", "md5")
    return changes.changed_files(files, old_rows(spark, sf_dir))


@query
def replace_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_rows(spark, sf_dir), new_rows(spark, sf_dir)
    rows = changes.changed_files(new, old).select(*new.columns)
    return longs(changes.replace_by_file(old, rows).select(*FILE_ROW, "kind_rank", "ord"), "kind_rank", "ord")


# ---- replies and entities -------------------------------------------------------------------


@query
def strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("conv_id", "part", text_columns.strip_fence(F.col("raw")).alias("stripped"))


@query
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_reply(replies(spark, sf_dir), "raw")
    return parsed.select(
        "conv_id",
        "part",
        F.col("reply.purpose").alias("purpose"),
        *[F.array_join(F.col(f"reply.{side}.{key}"), "|").alias(f"{side}_{key}") for side in ("classes", "functions") for key in ("name", "source_code")],
    )


@query
def quarantine_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_reply(damaged_replies(spark, sf_dir), "raw")
    return parsed.select("conv_id", "part", F.coalesce("reject", F.lit("ok")).alias("outcome"))


@query
def parse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_split_reply(replies(spark, sf_dir), "split_body")
    sides = [F.array_join(F.col(f"reply.{side}.{key}"), "|").alias(f"{side}_{key}") for side in ("classes", "functions") for key in ("name", "source_code")]
    return parsed.select("conv_id", "part", *sides)


def _reply_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = replies(spark, sf_dir).select(
        "project", "file", F.col("file").alias("name"), F.lit("Python").alias("lang"), F.md5("raw").alias("md5"),
        F.col("split_body").alias("text"), "raw",
    )
    return explode_entities(parse_reply(files, "raw"))


@query
def explode_entities_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reply_entities(spark, sf_dir).drop("md5", "raw")
    return longs(rows, "kind_rank", "ord")


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f.name for f in FILES.fields]
    return tagged_files(spark, sf_dir).select("doc_id", *columns)


@query
def build_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = jobs.build_entities(_source(spark, sf_dir), LOCAL).rows
    return _built_rows(built, "analysis_tokens", "embed_tokens")


def _built_rows(rows: DataFrame, *more: str) -> DataFrame:
    shown = rows.select(
        *FILE_ROW, F.md5("content").alias("content_md5"), vector_text(F.col("embedding")).alias("embedding"),
        "kind_rank", "ord", "n_chunks", *more,
    )
    return longs(shown, "kind_rank", "ord", "n_chunks")


# ---- chunks, pooling, vectors ---------------------------------------------------------------


@query
def pack_lines_(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pack_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return longs(chunks, "chunk_no", "n_chunks")


def _pooled_by_label(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """All vectors of a label as the chunks of one text, in the order of their ids."""
    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    numbered = with_running_sum(vectors.withColumn("one", F.lit(1).cast("long")), ["label"], ["vec_id"], "one", "chunk_no")
    chunks = numbered.withColumn("n_chunks", (F.col("last") + 1).cast("int"))
    chunks = chunks.withColumn("tokens", F.lit(1)).withColumn("error", F.lit(None).cast("string"))
    pooled = pool_chunks(chunks, ["label"], 64, mode, "embedding")
    return longs(pooled.select("label", "n_chunks", vector_text(F.col("embedding")).alias("embedding")), "label", "n_chunks")


@query
def pool_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled_by_label(spark, sf_dir, "window")


@query
def pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled_by_label(spark, sf_dir, "mean")


@query
def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut to different widths; only the full ones pass."""
    cut = F.slice("embedding", 1, (F.lit(64) - F.col("vec_id") % 3).cast("int"))
    cut = table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("embedding"))
    return cut.select("vec_id", F.size("embedding").cast("long").alias("width"), vector_ok(F.col("embedding"), 64).alias("fits"))


@query
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    said = run_model(texts, LOCAL.embed, "text", "embedding", EMBEDDING_TYPE)
    return said.select("doc_id", vector_text(F.col("embedding")).alias("embedding"), "tokens")


@query
def embed_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = jobs.embed_texts(table(spark, sf_dir, "documents"), ["doc_id"], "text", LOCAL)
    shown = pooled.select("doc_id", vector_text(F.col("embedding")).alias("embedding"), "n_chunks", "embed_tokens")
    return longs(shown, "n_chunks")


@query
def embed_rejected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are embedded whole; only what the model calls too long is packed and pooled."""
    models = replace(LOCAL, embed=local_models.embed_in_context, split_when="rejected")
    pooled = jobs.embed_texts(table(spark, sf_dir, "documents"), ["doc_id"], "text", models)
    shown = pooled.select("doc_id", vector_text(F.col("embedding")).alias("embedding"), "n_chunks", "embed_tokens", "error")
    return longs(shown, "n_chunks")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return knn(vectors, queries, ["vec_id"], "query_id", 64)


@query
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector."""
    return _neighbours(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query
def answer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.answer_count(_neighbours(spark, sf_dir), "query_id")


def _stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded and stored, as an index holds them."""
    path = fresh_path(spark, "documents")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    run_model(texts, LOCAL.embed, "content", "embedding", EMBEDDING_TYPE, keep_prompt=True).write.parquet(path)
    return spark.read.parquet(path)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retrieve(_stored_documents(spark, sf_dir), _questions(spark, sf_dir), LOCAL, ["doc_id"])


@query
def retrieve_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _retrieved(spark, sf_dir).select("query_id", "rank", "doc_id", "dist", "content")
    return found.withColumn("dist", F.round("dist", 6))


@query
def html_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text_columns.html_unescape("html").alias("html"))


# ---- digests and counts ---------------------------------------------------------------------


@query
def project_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.project_digest(stored_rows(spark, sf_dir), DIGEST_BYTES)


@query
def summary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_vectors(stored_rows(spark, sf_dir)).drop("doc_id")
    stale = rows.select("project").distinct()
    for column in rows.columns[1:]:
        value = F.lit(SUMMARY_FILE if column == "file" else None).cast(rows.schema[column].dataType)
        stale = stale.withColumn(column, value)
    models = replace(LOCAL, part_bytes=DIGEST_BYTES)
    rebuilt = jobs.upsert_summary(rows.unionByName(stale), models)
    return _built_rows(rebuilt)


@query
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = with_content(_reply_entities(spark, sf_dir))
    counted = entities.withColumns(
        {
            "analysis_tokens": F.when(F.col("kind_rank") == 0, F.length("raw")).otherwise(0).cast("long"),
            "embed_tokens": F.length("content").cast("long"),
        }
    )
    return digest.token_usage(counted)


@query
def completion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_reply(damaged_replies(spark, sf_dir), "raw")
    return digest.completion_gate(parsed.withColumn("ok", F.col("reject").isNull()))


# ---- prompts and model stages ---------------------------------------------------------------


@query
def analyse_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = prompts.analyse_prompt(F.col("lang"), F.col("text"), LANGUAGE)
    return tagged_files(spark, sf_dir).select("file", prompt.alias("prompt"))


@query
def split_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = prompts.split_prompt(F.col("lang"), F.col("text"), LANGUAGE)
    return tagged_files(spark, sf_dir).select("file", prompt.alias("prompt"))


@query
def ask_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.gather_contents(_retrieved(spark, sf_dir))
    return found.select("query_id", prompts.ask_prompt(F.col("query"), F.col("contents"), LANGUAGE).alias("prompt"))


@query
def summary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = digest.project_digest(stored_rows(spark, sf_dir), DIGEST_BYTES)
    return parts.select("project", "part_no", prompts.summary_prompt(F.col("digest"), LANGUAGE).alias("prompt"))


@query
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("query_id", prompts.chat_prompt(F.col("query"), LANGUAGE).alias("prompt"))


@query
def route_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per reply: the opening user turn, empty where there is none, over the reply's entities."""
    question = table(spark, sf_dir, "conversations").where("role = 'user'")
    question = question.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    parsed = parse_reply(replies(spark, sf_dir), "raw").join(question, "conv_id", "left")
    entities = F.concat("reply.classes", "reply.functions")
    listed = F.transform(entities, lambda e: F.struct(parsed["file"].alias("file"), e["name"].alias("name"), e["purpose"].alias("purpose")))
    prompt = prompts.route_prompt(F.coalesce("query", F.lit("")), listed, 5, LANGUAGE)
    return parsed.select("conv_id", "part", prompt.alias("prompt"))


@query
def analyse_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysed = jobs.analyse(_source(spark, sf_dir), LOCAL)
    return parse_reply(analysed).select(
        "file", F.col("reply.purpose").alias("purpose"), F.size("reply.classes").cast("long").alias("n_classes"),
        F.size("reply.functions").cast("long").alias("n_functions"), "analysis_tokens",
    )


@query
def summarise_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = jobs.summarise(stored_rows(spark, sf_dir), replace(LOCAL, part_bytes=DIGEST_BYTES))
    return said.select("project", "summary", "tokens")


@query
def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir).select("query_id", prompts.chat_prompt(F.col("query"), LANGUAGE).alias("prompt"))
    return run_model(asked, LOCAL.answer).select("query_id", "output", "tokens")


@query
def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = jobs.ask(_stored_documents(spark, sf_dir), _questions(spark, sf_dir), LOCAL, ["doc_id"])
    return said.select("query_id", "n_hits", "output", "tokens")


@query
def routed_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step asking over index rows; every reply names an unknown file and a repeated one."""
    index = with_vectors(stored_rows(spark, sf_dir))
    said = jobs.routed_ask(index, _questions(spark, sf_dir), LOCAL)
    return said.select("query_id", "n_files", "n_unknown", "output", "tokens")


# ---- jobs -----------------------------------------------------------------------------------


def _earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of an earlier run: some files are not there yet, some still have another text."""
    files = _source(spark, sf_dir).where("doc_id % 10 <> 0")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    return files.withColumn("text", text).withColumn("md5", F.md5("text"))


def _later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of now: some files of the earlier run are gone."""
    return _source(spark, sf_dir).where("doc_id % 11 <> 3")


@query
def rebuild_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim)
    jobs.rebuild_index(index, _source(spark, sf_dir), LOCAL)
    return _built_rows(index.rows())


@query
def refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim)
    jobs.rebuild_index(index, _earlier(spark, sf_dir), LOCAL)
    jobs.refresh_index(index, _later(spark, sf_dir), LOCAL)
    return _built_rows(index.rows())


@query
def refresh_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim)
    source, progress = fresh_path(spark, "listing"), fresh_path(spark, "progress")
    columns = [f.name for f in FILES.fields]
    for listing in (_earlier(spark, sf_dir), _later(spark, sf_dir)):
        listing.select(*columns).write.mode("append").parquet(source)
        start_refresh(spark, source, index, LOCAL, progress).awaitTermination()
    return _built_rows(index.rows())
