"""Prompt columns. Each builder takes columns and returns one string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY_SHAPE = '{"name": string, "source_code": string, "purpose": string}'
PIECE_SHAPE = '{"name": string, "source_code": string}'

ANALYSE_ASK = (
    "\n```\n\nExplain what the code is for and describe its classes and its functions.\n"
    "Reply with one valid JSON object and nothing else, shaped like this:\n"
    '{"purpose": string, "classes": [' + ENTITY_SHAPE + '], "functions": [' + ENTITY_SHAPE + "]}\n"
    "Copy each source_code unchanged from the code above."
)
SPLIT_ASK = (
    "\n```\n\nList the classes and the functions it defines, each with its source.\n"
    "Reply with one valid JSON object and nothing else, shaped like this:\n"
    '{"classes": [' + PIECE_SHAPE + '], "functions": [' + PIECE_SHAPE + "]}\n"
    "Copy each source_code unchanged from the code above."
)
ROUTE_ASK = (
    " of these files that matter most to the question, by their full path, each with a reason.\n"
    "Reply with one valid JSON object and nothing else, shaped like this:\n"
    '{"related_files": [{"file": string, "reason": string}]}'
)


def answer_in(body: Column, language: str) -> Column:
    return F.concat(body, F.lit(f"\n\nWrite all of the reply in {language}."))


def _code(programming_language: Column, code: Column) -> Column:
    return F.concat(F.lit("Below is a source file in "), programming_language, F.lit(":\n\n```\n"), code)


def _question(query: Column) -> Column:
    return F.concat(F.lit("A user asks:\n\n```\n"), query, F.lit("\n```\n\n"))


def analyse_prompt(programming_language: Column, code: Column, language: str) -> Column:
    return answer_in(F.concat(_code(programming_language, code), F.lit(ANALYSE_ASK)), language)


def split_prompt(programming_language: Column, code: Column, language: str) -> Column:
    return answer_in(F.concat(_code(programming_language, code), F.lit(SPLIT_ASK)), language)


def ask_prompt(query: Column, contents: Column, language: str) -> Column:
    """``contents`` is an array of retrieved texts in rank order."""
    body = F.concat(
        _question(query),
        F.lit("Answer with the help of these descriptions and sources:\n\n"),
        F.array_join(contents, "\n\n"),
        F.lit("\n\nDo not repeat the sources in full."),
    )
    return answer_in(body, language)


def summary_prompt(digest: Column, language: str) -> Column:
    body = F.concat(
        F.lit("These are the parts of a project and what each is for:\n\n```\n"),
        digest,
        F.lit("\n```\n\nSum the project up in a few sentences, in at most 8000 tokens."),
    )
    return answer_in(body, language)


def chat_prompt(query: Column, language: str) -> Column:
    return answer_in(F.concat(_question(query), F.lit("Give a sensible reply.")), language)


def route_prompt(query: Column, files: Column, max_files: int, language: str) -> Column:
    """``files`` is an array of ``struct<file, name, purpose>``."""
    listed = F.transform(
        files,
        lambda f: F.concat(
            F.lit('{"file": '), f["file"], F.lit(', "name": '), f["name"],
            F.lit(', "purpose": '), f["purpose"], F.lit("}"),
        ),
    )
    body = F.concat(
        _question(query),
        F.lit("The source files at hand:\n\n[\n"),
        F.array_join(listed, ",\n"),
        F.lit(f"\n]\n\nName at most {max_files}" + ROUTE_ASK),
    )
    return answer_in(body, language)
