"""The same results as plain SQL for DuckDB, written independently of the DataFrame code.

Expected rows are built from the given tables directly: entities from the turns, not by parsing;
packing by a recursive walk over lines; neighbours by comparing all pairs.
"""

from __future__ import annotations

from sourcelode import catalogs
from sourcelode.functions import prompts

ORACLE: dict[str, str] = {}

LANGUAGE = "English"
DIGEST_BYTES = 4096


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_text(word) for word in words) + "]"


def with_ctes(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


def vector_text(vector: str) -> str:
    return (
        f"array_to_string(list_transform({vector}, "
        "lambda x: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT)), ',')"
    )


def hex_vector(text: str) -> str:
    return (
        "list_transform(range(1, 33), lambda i: "
        f"CAST((strpos('0123456789abcdef', substr(md5({text}), CAST(i AS INT), 1)) - 1) / 16.0 AS FLOAT))"
    )


def distance(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_zip({a}, {b}), "
        "lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
    )


def digit(digest: str, position: int) -> str:
    return f"(strpos('0123456789abcdef', substr({digest}, {position}, 1)) - 1)"


# ---- derived relations ----------------------------------------------------------------------

FILES = """files AS (
  SELECT *, '/proj/' || project || '/' || rel_path AS file, '/proj/' || project || '/' || rel_path AS name
  FROM (
    SELECT doc_id, source AS project, text, md5(text) AS md5,
      'm' || doc_id || '/' ||
      CASE doc_id % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'tests' WHEN 2 THEN 'target' WHEN 3 THEN 'lib'
        WHEN 4 THEN 'docTest' WHEN 5 THEN 'node_modules' WHEN 6 THEN 'core' ELSE 'pkg.egg-info' END || '/' ||
      CASE doc_id % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'test_x' WHEN 2 THEN 'util' WHEN 3 THEN 'README' ELSE 'mod' END ||
      CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.md' WHEN 3 THEN '.h' WHEN 4 THEN '.m'
        WHEN 5 THEN '.R' WHEN 6 THEN '.java' WHEN 7 THEN '.sh' ELSE '' END AS rel_path,
      CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.md' WHEN 3 THEN '.h' WHEN 4 THEN '.m'
        WHEN 5 THEN '.R' WHEN 6 THEN '.java' WHEN 7 THEN '.sh' ELSE '' END AS ext,
      CASE doc_id % 9 WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' WHEN 3 THEN 'C' WHEN 4 THEN 'MATLAB'
        WHEN 6 THEN 'Java' WHEN 7 THEN 'Shell' ELSE 'unknown' END AS lang
    FROM documents))"""

ROWS = """numbered AS (SELECT files.*, t.o FROM files, LATERAL (SELECT unnest(range(0, doc_id % 3 + 1)) AS o) t),
stored AS (
  SELECT doc_id, project, file, CASE WHEN doc_id % 7 = 0 THEN md5(text || ' old') ELSE md5 END AS md5,
    CASE WHEN o = 0 THEN 'file' ELSE 'class' END AS code_type, lang,
    CASE WHEN o = 0 THEN name ELSE 'K' || o END AS name, 'about ' || doc_id || '.' || o AS purpose,
    CAST(CASE WHEN o = 0 THEN 0 ELSE 1 END AS BIGINT) AS kind_rank, CAST(o AS BIGINT) AS ord
  FROM numbered),
old AS (SELECT * FROM stored WHERE doc_id % 10 <> 0),
new AS (
  SELECT doc_id, project, file, md5, 'file' AS code_type, lang, name, 'about ' || doc_id || '.0' AS purpose,
    CAST(0 AS BIGINT) AS kind_rank, CAST(0 AS BIGINT) AS ord
  FROM files)"""

ROW = "project, file, md5, code_type, lang, name, purpose"

TURNS = """turns AS (SELECT *, CAST(turn // 8 AS BIGINT) AS part FROM conversations),
heads AS (SELECT conv_id, part FROM turns GROUP BY ALL),
entities AS (
  SELECT conv_id, part, turn, CASE role WHEN 'assistant' THEN 'function' ELSE 'class' END AS code_type,
    CASE role WHEN 'assistant' THEN 'f' ELSE 'c' END || turn AS name,
    replace(text, '```', '') AS source_code, 'turn ' || turn AS purpose
  FROM turns)"""


def reply_json(entry_keys: str, head: str) -> str:
    """JSON text of one reply per head, as a column expression over aggregated turns."""
    return f"""json_texts AS (
  SELECT h.conv_id, h.part,
    '{{' || {head} '"classes":[' ||
    coalesce((SELECT string_agg({entry_keys}, ',' ORDER BY turn) FROM turns t
      WHERE t.conv_id = h.conv_id AND t.part = h.part AND role <> 'assistant'), '') || '],"functions":[' ||
    coalesce((SELECT string_agg({entry_keys}, ',' ORDER BY turn) FROM turns t
      WHERE t.conv_id = h.conv_id AND t.part = h.part AND role = 'assistant'), '') || ']}}' AS body
  FROM heads h)"""


ENTRY = (
    "'{\"name\":\"' || CASE role WHEN 'assistant' THEN 'f' ELSE 'c' END || turn || '\",\"source_code\":' || "
    "CAST(to_json(text) AS VARCHAR) || ',\"purpose\":\"turn ' || turn || '\"}'"
)
BODY = reply_json(ENTRY, "'\"purpose\":\"p' || h.conv_id || '\",' || ")
SPLIT_BODY = reply_json(ENTRY, "").replace("json_texts", "split_texts")


# ---- sources and sinks ----------------------------------------------------------------------

RULE_SETS = {
    "directories": (catalogs.IGNORE_DIRECTORIES, "c = p"),
    "directory_prefix": (catalogs.IGNORE_DIRECTORY_PREFIX, "starts_with(c, p)"),
    "directory_suffix": (catalogs.IGNORE_DIRECTORY_SUFFIX, "ends_with(c, p)"),
    "files": (catalogs.IGNORE_FILES, "c = p"),
    "file_prefix": (catalogs.IGNORE_FILE_PREFIX, "starts_with(c, p)"),
    "file_suffix": (catalogs.IGNORE_FILE_SUFFIX, "ends_with(c, p)"),
}
RULES = "rules AS (SELECT DISTINCT kind, pattern FROM (\n" + "\nUNION ALL ".join(
    f"SELECT '{kind}' AS kind, unnest({sql_list(words)}) AS pattern" for kind, (words, _) in RULE_SETS.items()
) + "))"

COMPONENTS = """components AS (
  SELECT doc_id, i, parts[i] AS c, array_to_string(parts[1:i], '/') AS path
  FROM (SELECT doc_id, string_split(rel_path, '/') AS parts FROM files),
    LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))"""

HITS = """hits AS (
  SELECT DISTINCT doc_id, kind, pattern FROM components JOIN rules ON CASE kind
    WHEN 'directories' THEN c = pattern WHEN 'files' THEN c = pattern
    WHEN 'directory_prefix' THEN starts_with(c, pattern) WHEN 'file_prefix' THEN starts_with(c, pattern)
    ELSE ends_with(c, pattern) END)"""

LANGUAGES = "languages AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {sql_text(name)}, {sql_text(ext)})"
    for i, (name, exts) in enumerate(catalogs.LANGUAGE_EXTENSIONS.items())
    for ext in exts
) + ") AS t(priority, language, ext)),\nextensions AS (SELECT ext, arg_min(language, priority) AS language FROM languages GROUP BY ext)"

ORACLE["scan_files"] = with_ctes(FILES, RULES, COMPONENTS, HITS) + """
SELECT project, rel_path, lang,
  CASE WHEN doc_id % 7 = 0 THEN md5('') ELSE md5 END AS md5,
  doc_id % 7 <> 0 AS decode_ok,
  CASE WHEN doc_id % 7 = 0 THEN 0 ELSE CAST(strlen(text) AS BIGINT) END AS n_bytes
FROM files WHERE lang <> 'unknown' AND doc_id NOT IN (SELECT doc_id FROM hits)"""

ORACLE["read_tree"] = ORACLE["scan_files"]
ORACLE["decode_text"] = """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text, doc_id % 7 <> 0 AS decode_ok FROM documents"""

ORACLE["open_or_create"] = """
SELECT 'created' AS step, CAST(0 AS BIGINT) AS n_rows, CAST(13 AS BIGINT) AS n_columns
UNION ALL SELECT 'opened', count(*), 13 FROM documents"""

ORACLE["append_entities"] = with_ctes(FILES, ROWS) + f"""
SELECT {ROW}, kind_rank, ord FROM old
UNION ALL SELECT {ROW}, kind_rank, ord FROM new WHERE doc_id % 10 = 0"""

ORACLE["scan_all"] = with_ctes(FILES, ROWS) + f"""
SELECT {ROW}, purpose AS content, {vector_text(hex_vector('purpose'))} AS embedding, kind_rank, ord,
  CAST(1 AS BIGINT) AS n_chunks, true AS decode_ok FROM stored"""

ORACLE["ignore_catalog"] = with_ctes(FILES, RULES, COMPONENTS, HITS) + """
SELECT kind, pattern, count(doc_id) AS n_files FROM rules LEFT JOIN hits USING (kind, pattern) GROUP BY ALL"""

ORACLE["ext_catalog_invert"] = with_ctes(FILES, LANGUAGES) + """
SELECT e.ext, language, count(doc_id) AS n_files FROM extensions e LEFT JOIN files f ON e.ext = f.ext GROUP BY ALL"""

ORACLE["ext_catalog_regroup"] = with_ctes(FILES, LANGUAGES) + """
SELECT e.language, exts, count(doc_id) AS n_files
FROM (SELECT language, string_agg(ext, ',' ORDER BY ext) AS exts FROM extensions GROUP BY 1) e
LEFT JOIN files f ON e.language = f.lang GROUP BY ALL"""

# ---- filters and projections ----------------------------------------------------------------

ORACLE["ignore_rules"] = with_ctes(FILES, RULES, COMPONENTS, HITS) + """
SELECT project, file FROM files WHERE doc_id NOT IN (SELECT doc_id FROM hits)"""

ORACLE["ignore_paths"] = with_ctes(FILES) + """
SELECT project, file FROM files
WHERE project <> 'src3' AND NOT (project = 'src5' AND doc_id = 25) AND NOT (project = 'src7' AND starts_with(rel_path, 'm7/node_modules/'))"""

ROOTED = f"""ways AS (
  SELECT doc_id, i, string_split(rel_path, '/')[i] AS c, array_to_string(string_split(rel_path, '/')[1:i], '/') AS p,
    '/proj/' || project || '/' || array_to_string(string_split(rel_path, '/')[1:i], '/') AS whole
  FROM (SELECT *, unnest(range(1, len(string_split(rel_path, '/')) + 1)) AS i FROM files)),
met AS (
  SELECT doc_id, arg_min(reason, i) AS reason FROM (
    SELECT doc_id, i, CASE
      WHEN p IN (SELECT unnest({sql_list(f'm{n}/node_modules' for n in range(5, 400, 16))}))
        OR whole IN (SELECT unnest({sql_list(f'/proj/src{n}/m{n}' for n in range(20))})) THEN 'directory_path'
      WHEN starts_with(c, 'core') THEN 'directory_prefix'
      WHEN p IN ('m0/target/README', 'm1/target/README', 'm2/target/README', 'm3/target/README', 'm4/target/README', 'm18/target/README.py')
        OR whole = '/proj/src8/m8/src/README' THEN 'file_path'
      WHEN ends_with(c, '.java') THEN 'file_suffix' END AS reason
    FROM ways) WHERE reason IS NOT NULL GROUP BY doc_id)"""
ORACLE["reject_path_reasons"] = with_ctes(FILES, ROOTED) + """
SELECT coalesce(reason, CASE WHEN ext = '' THEN 'no_extension' WHEN lang = 'unknown' THEN 'unknown_extension' ELSE 'kept' END) AS reason,
  count(*) AS n_files FROM files LEFT JOIN met USING (doc_id) GROUP BY 1"""
ORACLE["ignore_rooted"] = with_ctes(FILES, ROOTED) + """
SELECT project, file FROM files WHERE doc_id NOT IN (SELECT doc_id FROM met)"""

ORACLE["reject_reasons"] = with_ctes(FILES, RULES, COMPONENTS) + """,
ranked AS (
  SELECT doc_id, i, min(CASE kind
    WHEN 'directories' THEN '1directory_name' WHEN 'directory_prefix' THEN '3directory_prefix'
    WHEN 'directory_suffix' THEN '4directory_suffix' WHEN 'files' THEN '5file_name'
    WHEN 'file_prefix' THEN '7file_prefix' ELSE '8file_suffix' END) AS reason
  FROM components JOIN rules ON CASE kind
    WHEN 'directories' THEN c = pattern WHEN 'files' THEN c = pattern
    WHEN 'directory_prefix' THEN starts_with(c, pattern) WHEN 'file_prefix' THEN starts_with(c, pattern)
    ELSE ends_with(c, pattern) END
  GROUP BY ALL),
firsts AS (SELECT doc_id, substr(arg_min(reason, i), 2) AS reason FROM ranked GROUP BY doc_id)
SELECT coalesce(firsts.reason, CASE WHEN ext = '' THEN 'no_extension' WHEN lang = 'unknown' THEN 'unknown_extension' ELSE 'kept' END) AS reason,
  count(*) AS n_files
FROM files LEFT JOIN firsts USING (doc_id) GROUP BY 1""".replace("\n,", ",")

ORACLE["ext_whitelist"] = with_ctes(FILES) + "SELECT project, file FROM files WHERE lang <> 'unknown'"
ORACLE["file_extension"] = with_ctes(FILES) + "SELECT file, ext FROM files"
ORACLE["tag_language"] = with_ctes(FILES) + "SELECT file, lang FROM files"
ORACLE["point_lookup"] = with_ctes(FILES, ROWS) + f"""
SELECT {ROW}, kind_rank, ord FROM stored WHERE code_type = 'class'"""
ORACLE["delete_file"] = with_ctes(FILES, ROWS) + f"SELECT {ROW}, ord FROM stored WHERE doc_id % 13 <> 0"
ORACLE["clean_all"] = with_ctes(FILES, ROWS) + """
SELECT 'before' AS state, count(*) + count(DISTINCT project) AS n_rows FROM stored UNION ALL SELECT 'after', 0"""
ORACLE["compose_content"] = with_ctes(FILES) + r"""
SELECT file, '//file ' || file || ' ' || chr(10) || '//file name: ' || name || chr(10) || chr(10) || '// about ' || doc_id || chr(10) || text AS content
FROM files"""

# ---- changes --------------------------------------------------------------------------------

ORACLE["fingerprint"] = "SELECT doc_id, md5(text) AS md5 FROM documents"
ORACLE["changed_files"] = with_ctes(FILES) + """
SELECT project, file, md5 FROM files WHERE doc_id % 10 = 0 OR doc_id % 7 = 0"""
ORACLE["replace_by_file"] = with_ctes(FILES, ROWS) + f"""
SELECT {ROW}, kind_rank, ord FROM old WHERE doc_id % 7 <> 0
UNION ALL SELECT {ROW}, kind_rank, ord FROM new WHERE doc_id % 10 = 0 OR doc_id % 7 = 0"""

# ---- replies and entities -------------------------------------------------------------------

ORACLE["strip_fence"] = with_ctes(TURNS, BODY) + """
SELECT conv_id, part, replace(body, '```', '') || chr(10) AS stripped FROM json_texts"""

SIDES = ",\n  ".join(
    f"coalesce((SELECT string_agg({key}, '|' ORDER BY turn) FROM entities e WHERE e.conv_id = h.conv_id "
    f"AND e.part = h.part AND code_type = '{kind}'), '') AS {side}_{key}"
    for side, kind in (("classes", "class"), ("functions", "function"))
    for key in ("name", "source_code")
)
ORACLE["parse_response"] = with_ctes(TURNS) + f"SELECT conv_id, part, 'p' || conv_id AS purpose,\n  {SIDES} FROM heads h"
ORACLE["parse_split"] = with_ctes(TURNS.replace("replace(text, '```', '')", "text")) + f"SELECT conv_id, part,\n  {SIDES} FROM heads h"

OUTCOME = """CASE conv_id % 10 WHEN 0 THEN 'bad_classes' WHEN 1 THEN 'not_json' WHEN 2 THEN 'not_json'
  WHEN 3 THEN 'bad_purpose' WHEN 5 THEN 'not_json' WHEN 7 THEN 'bad_functions_entry'
  WHEN 8 THEN 'bad_functions_entry' ELSE 'ok' END"""
ORACLE["quarantine_response"] = with_ctes(TURNS) + f"SELECT conv_id, part, {OUTCOME} AS outcome FROM heads"

REPLY_FILE = "'conv' || (conv_id % 5) AS project, '/conv/c' || conv_id || '/p' || part || '.py' AS file"
REPLY_ROWS = f"""reply_rows AS (
  SELECT {REPLY_FILE}, conv_id, part, 'file' AS code_type, '/conv/c' || conv_id || '/p' || part || '.py' AS name,
    'p' || conv_id AS purpose, body AS source_code, CAST(0 AS BIGINT) AS kind_rank, CAST(0 AS BIGINT) AS ord
  FROM split_texts
  UNION ALL
  SELECT {REPLY_FILE}, conv_id, part, code_type, name, purpose, source_code,
    CAST(CASE code_type WHEN 'class' THEN 1 ELSE 2 END AS BIGINT),
    CAST(row_number() OVER (PARTITION BY conv_id, part, code_type ORDER BY turn) AS BIGINT)
  FROM entities)"""
ORACLE["explode_entities"] = with_ctes(TURNS, SPLIT_BODY, REPLY_ROWS) + """
SELECT project, file, 'Python' AS lang, code_type, name, purpose, source_code, kind_rank, ord FROM reply_rows"""

CONTENT = (
    "'//file ' || file || ' ' || chr(10) || '//' || code_type || ' name: ' || name || chr(10) || chr(10) || "
    "'// ' || purpose || chr(10) || source_code"
)
ORACLE["token_usage"] = with_ctes(TURNS, SPLIT_BODY, BODY, REPLY_ROWS) + f"""
SELECT project, file, max(length(body) + 12) AS analysis_tokens, CAST(sum(length({CONTENT})) AS BIGINT) AS embed_tokens
FROM reply_rows JOIN json_texts USING (conv_id, part) GROUP BY ALL"""
ORACLE["completion_gate"] = with_ctes(TURNS) + f"""
SELECT 'conv' || (conv_id % 5) AS project, count(*) AS n_files, count(*) FILTER ({OUTCOME} = 'ok') AS n_done,
  bool_and({OUTCOME} = 'ok') AS complete FROM heads GROUP BY 1"""

# ---- chunks, pooling, vectors ---------------------------------------------------------------


def packing(source: str, key: str, text: str) -> str:
    """CTEs ``chunk_rows(key..., chunk_no, chunk, oversize)``: a walk over the lines of ``source``."""
    return f"""texts AS (SELECT {key}, string_split({text}, chr(10)) AS lines FROM {source}),
measured AS (SELECT {key}, list_transform(lines, lambda l: CAST(strlen(l) AS BIGINT)) AS sizes FROM texts),
walk AS (
  SELECT {key}, sizes, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS chunk_no, sizes[1] AS filled FROM measured
  UNION ALL
  SELECT {key}, sizes, i + 1,
    CASE WHEN filled + sizes[i + 1] < 8192 THEN chunk_no ELSE chunk_no + 1 END,
    CASE WHEN filled + sizes[i + 1] < 8192 THEN filled + sizes[i + 1] ELSE sizes[i + 1] END
  FROM walk WHERE i < len(sizes)),
runs AS (SELECT {key}, chunk_no, min(i) AS a, max(i) AS b, max(filled) AS filled FROM walk GROUP BY ALL),
chunk_rows AS (
  SELECT {key}, chunk_no, array_to_string(lines[a:b], chr(10)) AS chunk, filled >= 8192 AS oversize
  FROM runs JOIN texts USING ({key}))"""


POOL_32 = (
    "list_transform(range(0, 32), lambda i: CAST(list_sum(list_transform("
    "flat[i * k + 1:(i + 1) * k], lambda x: CAST(x AS DOUBLE))) / k AS FLOAT))"
)


def pooling(key: str) -> str:
    """CTEs ``pooled(key..., embedding, n_chunks, embed_tokens)`` over ``chunk_rows``."""
    return f"""vectors AS (SELECT {key}, chunk_no, {hex_vector('chunk')} AS v, length(chunk) AS tokens FROM chunk_rows),
flats AS (SELECT {key}, flatten(list(v ORDER BY chunk_no)) AS flat, count(*) AS k, CAST(sum(tokens) AS BIGINT) AS embed_tokens FROM vectors GROUP BY ALL),
pooled AS (SELECT {key}, {POOL_32} AS embedding, k AS n_chunks, embed_tokens FROM flats)"""


ORACLE["pack_lines"] = with_ctes(packing("documents", "doc_id", "text"), recursive=True) + """
SELECT doc_id, chunk_no, count(*) OVER (PARTITION BY doc_id) AS n_chunks, chunk, oversize FROM chunk_rows"""

ORACLE["embed_long_text"] = with_ctes(packing("documents", "doc_id", "text"), pooling("doc_id"), recursive=True) + f"""
SELECT doc_id, {vector_text('embedding')} AS embedding, n_chunks, embed_tokens FROM pooled"""

FLAT_LABELS = "flats AS (SELECT CAST(label AS BIGINT) AS label, flatten(list(embedding ORDER BY vec_id)) AS flat, count(*) AS k FROM embeddings GROUP BY label)"
WINDOW_64 = POOL_32.replace("range(0, 32)", "range(0, 64)")
MEAN_64 = (
    "list_transform(range(1, 65), lambda j: CAST(list_sum(list_transform(range(0, k), "
    "lambda c: CAST(flat[c * 64 + j] AS DOUBLE))) / k AS FLOAT))"
)
ORACLE["pool_window"] = with_ctes(FLAT_LABELS) + f"SELECT label, k AS n_chunks, {vector_text(WINDOW_64)} AS embedding FROM flats"
ORACLE["pool_mean"] = with_ctes(FLAT_LABELS) + f"SELECT label, k AS n_chunks, {vector_text(MEAN_64)} AS embedding FROM flats"
ORACLE["vector_check"] = """
SELECT vec_id, CAST(64 - vec_id % 3 AS BIGINT) AS width, vec_id % 3 = 0 AS fits FROM embeddings"""
ORACLE["embed_text"] = f"""
SELECT doc_id, {vector_text(hex_vector('text'))} AS embedding, CAST(length(text) AS BIGINT) AS tokens FROM documents"""

LONG_TEXTS = f"""long_texts AS (SELECT doc_id, text FROM documents WHERE strlen(text) >= 16384),
{packing('long_texts', 'doc_id', 'text')},
vectors AS (SELECT doc_id, chunk_no, {hex_vector('chunk')} AS v, strlen(chunk) < 16384 AS ok, length(chunk) AS tokens FROM chunk_rows),
flats AS (
  SELECT doc_id, flatten(list(v ORDER BY chunk_no)) AS flat, count(*) AS k, bool_and(ok) AS fine,
    CAST(sum(CASE WHEN ok THEN tokens ELSE 0 END) AS BIGINT) AS embed_tokens FROM vectors GROUP BY ALL),
pooled AS (SELECT doc_id, CASE WHEN fine THEN {POOL_32} END AS embedding, k AS n_chunks, embed_tokens, fine FROM flats)"""
ORACLE["embed_rejected_text"] = with_ctes(LONG_TEXTS, recursive=True) + f"""
SELECT doc_id, {vector_text('embedding')} AS embedding, n_chunks, embed_tokens,
  CASE WHEN NOT fine THEN 'over the maximum context length' END AS error FROM pooled
UNION ALL
SELECT doc_id, {vector_text(hex_vector('text'))}, 1, length(text), NULL FROM documents WHERE strlen(text) < 16384"""

NEIGHBOURS = f"""pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, {distance('c.embedding', 'q.embedding')} AS dist FROM embeddings q, embeddings c),
neighbours AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs) WHERE rank <= 10)"""
ORACLE["knn_l2"] = with_ctes(NEIGHBOURS) + "SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM neighbours"
ORACLE["answer_count"] = with_ctes(NEIGHBOURS) + "SELECT query_id, count(*) AS n_answers FROM neighbours GROUP BY 1"

FOUND = f"""asked AS (SELECT item_id AS query_id, text AS query, {hex_vector('text')} AS qv FROM benchmark),
held AS (SELECT doc_id, text AS content, {hex_vector('text')} AS v FROM documents),
pairs AS (SELECT query_id, query, doc_id, {distance('v', 'qv')} AS dist FROM asked, held),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM pairs),
found AS (SELECT ranked.*, content FROM ranked JOIN held USING (doc_id) WHERE rank <= 10)"""
ORACLE["retrieve_text"] = with_ctes(FOUND) + "SELECT query_id, rank, doc_id, round(dist, 6) AS dist, content FROM found"

ORACLE["html_unescape"] = """
SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS html FROM pages"""

# ---- prompts --------------------------------------------------------------------------------

IN_LANGUAGE = sql_text(f"\n\nWrite all of the reply in {LANGUAGE}.")


def code_prompt(ask: str) -> str:
    return f"{sql_text('Below is a source file in ')} || lang || {sql_text(chr(58) + chr(10) * 2 + '```' + chr(10))} || text || {sql_text(ask)} || {IN_LANGUAGE}"


def question(query: str) -> str:
    return f"{sql_text('A user asks:' + chr(10) * 2 + '```' + chr(10))} || {query} || {sql_text(chr(10) + '```' + chr(10) * 2)}"


ANALYSE_PROMPT = code_prompt(prompts.ANALYSE_ASK)
CHAT_PROMPT = f"{question('text')} || 'Give a sensible reply.' || {IN_LANGUAGE}"
ORACLE["analyse_prompt"] = with_ctes(FILES) + f"SELECT file, {ANALYSE_PROMPT} AS prompt FROM files"
ORACLE["split_prompt"] = with_ctes(FILES) + f"SELECT file, {code_prompt(prompts.SPLIT_ASK)} AS prompt FROM files"
ORACLE["chat_prompt"] = f"SELECT item_id AS query_id, {CHAT_PROMPT} AS prompt FROM benchmark"

ASKED = f"""prompts AS (
  SELECT query_id, count(*) AS n_hits, {question('query')} ||
    {sql_text('Answer with the help of these descriptions and sources:' + chr(10) * 2)} ||
    string_agg(content, chr(10) || chr(10) ORDER BY rank) ||
    {sql_text(chr(10) * 2 + 'Do not repeat the sources in full.')} || {IN_LANGUAGE} AS prompt
  FROM found GROUP BY query_id, query)"""
ORACLE["ask_prompt"] = with_ctes(FOUND, ASKED) + "SELECT query_id, prompt FROM prompts"
ORACLE["ask_batch"] = with_ctes(FOUND, ASKED) + """
SELECT query_id, n_hits, 'Answer ' || md5(prompt) AS output, CAST(length(prompt) AS BIGINT) AS tokens FROM prompts"""
ORACLE["answer_batch"] = f"""
SELECT item_id AS query_id, 'Answer ' || md5({CHAT_PROMPT}) AS output, CAST(length({CHAT_PROMPT}) AS BIGINT) AS tokens FROM benchmark"""

ROUTED = f"""asked AS (SELECT item_id AS query_id, text AS query, {hex_vector('text')} AS qv FROM benchmark),
held AS (SELECT *, {hex_vector('purpose')} AS v FROM stored),
pairs AS (SELECT query_id, query, project, file, kind_rank, ord, {distance('v', 'qv')} AS dist FROM asked, held),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, project, file, kind_rank, ord) AS rank FROM pairs),
named AS (SELECT query_id, query, file, project, min(rank) AS place FROM ranked WHERE rank IN (1, 3) GROUP BY ALL),
prompts AS (
  SELECT query_id, count(*) AS n_files, {question('named.query')} ||
    {sql_text('Answer with the help of these descriptions and sources:' + chr(10) * 2)} ||
    string_agg(purpose, chr(10) || chr(10) ORDER BY place) ||
    {sql_text(chr(10) * 2 + 'Do not repeat the sources in full.')} || {IN_LANGUAGE} AS prompt
  FROM named JOIN stored USING (project, file) WHERE kind_rank = 0 GROUP BY query_id, named.query)"""
ORACLE["routed_ask"] = with_ctes(FILES, ROWS, ROUTED) + """
SELECT query_id, n_files, CAST(1 AS BIGINT) AS n_unknown, 'Answer ' || md5(prompt) AS output, CAST(length(prompt) AS BIGINT) AS tokens FROM prompts"""

LISTED = (
    "'{\"file\": /conv/c' || conv_id || '/p' || part || '.py, \"name\": ' || name || ', \"purpose\": ' || purpose || '}'"
)
ORACLE["route_prompt"] = with_ctes(TURNS) + f""",
listed AS (
  SELECT conv_id, part, string_agg({LISTED}, ',' || chr(10) ORDER BY code_type, turn) AS files FROM entities GROUP BY ALL),
openers AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, part, {question("coalesce(query, '')")} || {sql_text('The source files at hand:' + chr(10) * 2 + '[' + chr(10))} ||
  coalesce(files, '') || {sql_text(chr(10) + ']' + chr(10) * 2 + 'Name at most 5' + prompts.ROUTE_ASK)} || {IN_LANGUAGE} AS prompt
FROM heads LEFT JOIN openers USING (conv_id) LEFT JOIN listed USING (conv_id, part)"""


def summary_text(digest: str) -> str:
    return (
        f"{sql_text('These are the parts of a project and what each is for:' + chr(10) * 2 + '```' + chr(10))} || {digest} || "
        f"{sql_text(chr(10) + '```' + chr(10) * 2 + 'Sum the project up in a few sentences, in at most 8000 tokens.')} || {IN_LANGUAGE}"
    )


def digest_level(level: int, source: str, size: int) -> str:
    """CTEs for one round of digests, cut every ``size`` bytes, over ``source(project, file, kind_rank, ord, purpose)``."""
    return f"""lined{level} AS (SELECT *, file || ': ' || purpose AS line FROM {source}),
placed{level} AS (
  SELECT project, line, row_number() OVER w AS pos,
    coalesce(sum(least(octet_length(encode(line)) + 1, {size // 2})) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM lined{level} WINDOW w AS (PARTITION BY project ORDER BY file, kind_rank, ord, line)),
parted{level} AS (
  SELECT project, line, pos, CAST(before // {size} AS BIGINT) AS part_no,
    CAST(max(before) OVER (PARTITION BY project) // {size} + 1 AS BIGINT) AS n_parts FROM placed{level}),
digests{level} AS (
  SELECT project, part_no, n_parts, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS digest FROM parted{level} GROUP BY ALL),
said{level} AS (
  SELECT project, part_no, n_parts, 'Summary "' || substr(md5({summary_text('digest')}), 1, 12) || '" & more' AS summary,
    length({summary_text('digest')}) AS tokens FROM digests{level}),
next{level} AS (
  SELECT project, 'part ' || lpad(CAST(part_no AS VARCHAR), 12, '0') AS file, 0 AS kind_rank, 0 AS ord, summary AS purpose
  FROM said{level} WHERE n_parts > 1)"""


def summaries(source: str, size: int) -> str:
    """CTEs ``summaries(project, summary, tokens)``; three rounds reach far beyond the given tables."""
    return ",\n".join(
        [
            digest_level(1, source, size),
            digest_level(2, "next1", size),
            digest_level(3, "next2", size),
            """said AS (SELECT * FROM said1 UNION ALL SELECT * FROM said2 UNION ALL SELECT * FROM said3),
summaries AS (SELECT project, max(summary) FILTER (n_parts = 1) AS summary, CAST(sum(tokens) AS BIGINT) AS tokens FROM said GROUP BY 1)""",
        ]
    )


ORACLE["project_digest"] = with_ctes(FILES, ROWS, digest_level(1, "stored", DIGEST_BYTES)) + """
SELECT project, part_no, n_parts, n_lines, digest FROM digests1"""
ORACLE["summary_prompt"] = with_ctes(FILES, ROWS, digest_level(1, "stored", DIGEST_BYTES)) + f"""
SELECT project, part_no, {summary_text('digest')} AS prompt FROM digests1"""
ORACLE["summarise_batch"] = with_ctes(FILES, ROWS, summaries("stored", DIGEST_BYTES)) + "SELECT project, summary, tokens FROM summaries"

SUMMARY_CONTENT = (
    "'//file whole project ' || chr(10) || '//file name: whole project summary' || chr(10) || chr(10) || "
    "'// ' || summary || chr(10)"
)
SUMMARY_ROWS = f"""
SELECT project, 'whole project' AS file, '' AS md5, 'file' AS code_type, '' AS lang, 'whole project summary' AS name,
  summary AS purpose, md5({SUMMARY_CONTENT}) AS content_md5, {vector_text(hex_vector(SUMMARY_CONTENT))} AS embedding,
  CAST(0 AS BIGINT) AS kind_rank, CAST(0 AS BIGINT) AS ord, CAST(1 AS BIGINT) AS n_chunks
FROM summaries"""
ORACLE["summary_upsert"] = with_ctes(FILES, ROWS, summaries("stored", DIGEST_BYTES)) + f"""
SELECT {ROW}, md5(purpose) AS content_md5, {vector_text(hex_vector('purpose'))} AS embedding, kind_rank, ord,
  CAST(1 AS BIGINT) AS n_chunks FROM stored UNION ALL {SUMMARY_ROWS}"""

# ---- analysis and jobs ----------------------------------------------------------------------


def analysed(source: str) -> str:
    """CTEs from files to ``built``: what the local model says of each, composed, packed and pooled."""
    names = "('class', 1, 1), ('function', 2, 2)"
    return f"""digested AS (SELECT f.*, md5({ANALYSE_PROMPT}) AS h, length({ANALYSE_PROMPT}) AS asked FROM {source} f),
kinds AS (SELECT * FROM (VALUES {names}) AS t(kind, rank, place)),
listed AS (
  SELECT d.*, kind, rank, i FROM digested d, kinds,
    LATERAL (SELECT unnest(range(0, (strpos('0123456789abcdef', substr(h, place, 1)) - 1) % 3)) AS i)),
rows_built AS (
  SELECT project, file, md5, 'file' AS code_type, lang, name, 'purpose ' || substr(h, 1, 8) AS purpose, text AS source_code,
    CAST(0 AS BIGINT) AS kind_rank, CAST(0 AS BIGINT) AS ord, CAST(asked AS BIGINT) AS analysis_tokens FROM digested
  UNION ALL
  SELECT project, file, md5, kind, lang, kind || i || '_' || substr(h, 3, 4), kind || ' of ' || substr(h, 29, 4),
    kind || ' ' || substr(h, CAST(8 * i + 1 AS INT), 8), rank, i + 1, 0 FROM listed),
composed AS (SELECT *, {CONTENT} AS content FROM rows_built),
{packing('composed', 'project, file, kind_rank, ord', 'content')},
{pooling('project, file, kind_rank, ord')},
built AS (SELECT * FROM composed JOIN pooled USING (project, file, kind_rank, ord))"""


BUILT = f"""
SELECT project, file, md5, code_type, lang, name, purpose, md5(content) AS content_md5, {vector_text('embedding')} AS embedding,
  kind_rank, ord, n_chunks"""

ORACLE["analyse_batch"] = with_ctes(FILES) + f"""
SELECT file, 'purpose ' || substr(h, 1, 8) AS purpose, CAST({digit('h', 1)} % 3 AS BIGINT) AS n_classes,
  CAST({digit('h', 2)} % 3 AS BIGINT) AS n_functions, analysis_tokens
FROM (SELECT file, md5({ANALYSE_PROMPT}) AS h, CAST(length({ANALYSE_PROMPT}) AS BIGINT) AS analysis_tokens FROM files)"""

ORACLE["build_entities"] = with_ctes(FILES, analysed("files"), recursive=True) + BUILT + ", analysis_tokens, embed_tokens FROM built"


def indexed(source: str) -> str:
    return (
        with_ctes(FILES, source, analysed("final_files"), summaries("built", 262144), recursive=True)
        + BUILT
        + " FROM built UNION ALL "
        + SUMMARY_ROWS
    )


ORACLE["rebuild_index"] = indexed("final_files AS (SELECT project, file, md5, text, lang, name FROM files)")
REFRESHED = """final_files AS (
  SELECT project, file, md5(t) AS md5, t AS text, lang, name FROM (
    SELECT *, CASE WHEN doc_id % 11 <> 3 THEN text WHEN doc_id % 7 = 0 THEN text || ' old' ELSE text END AS t
    FROM files WHERE doc_id % 11 <> 3 OR doc_id % 10 <> 0))"""
ORACLE["refresh_index"] = indexed(REFRESHED)
ORACLE["refresh_stream"] = indexed(REFRESHED)
