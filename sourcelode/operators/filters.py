"""Ignore rules, extension whitelist and language tags over file listings."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelode.catalogs import RULE_KINDS, UNKNOWN_LANGUAGE, IgnoreRules
from sourcelode.functions.text import extension
from sourcelode.session import broadcast_if_small


def _any_of(words: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(word) for word in dict.fromkeys(words)) + ")"


def rooted(words: Sequence[str]) -> list[str]:
    """The entries that are absolute paths, without a closing slash."""
    return list(dict.fromkeys(f"/{word.strip('/')}" for word in words if word.startswith("/")))


def _at_root(rel_path: Column, absolute: Column) -> Column:
    """The project root with its closing slash: what stands before the relative path."""
    return F.substring(absolute, F.lit(1), F.length(absolute) - F.length(rel_path))


def ignored(rel_path: Column, rules: IgnoreRules, absolute: Column | None = None) -> Column:
    """True when any component of a path below the project root breaks any rule.

    Every rule looks at every component, so the whole walk is one regular expression on the path.
    Rules that are absolute paths need ``absolute``, the file's own absolute path.
    """
    listed = rooted([*rules.directories, *rules.files])
    if not listed:
        return _ignored_below(rel_path, rules)
    if absolute is None:
        raise ValueError("absolute rules need the column of absolute paths")
    root = _at_root(rel_path, absolute)
    on_the_way = F.exists(ancestors(rel_path), lambda p: F.concat(root, p).isin(*listed))
    return _ignored_below(rel_path, rules) | F.coalesce(on_the_way, F.lit(False))


def _ignored_below(rel_path: Column, rules: IgnoreRules) -> Column:
    exact = [word for word in (*rules.directories, *rules.files) if not word.startswith("/")]
    prefixes = [*rules.directory_prefix, *rules.file_prefix]
    suffixes = [*rules.directory_suffix, *rules.file_suffix]
    parts = []
    names = [word for word in exact if "/" not in word]
    paths = [word.strip("/") for word in exact if "/" in word]
    if names:
        parts.append(r"(?:\A|/)" + _any_of(names) + r"(?:/|\z)")
    if paths:
        parts.append(r"\A" + _any_of(paths) + r"(?:/|\z)")
    if prefixes:
        parts.append(r"(?:\A|/)" + _any_of(prefixes))
    if suffixes:
        parts.append(_any_of(suffixes) + r"(?:/|\z)")
    return rel_path.rlike("|".join(parts)) if parts else F.lit(False)


def apply_ignore_rules(
    files: DataFrame, rules: IgnoreRules, path: str = "rel_path", absolute: str | None = None
) -> DataFrame:
    return files.where(~ignored(F.col(path), rules, F.col(absolute) if absolute else None))


def ancestors(rel_path: Column) -> Column:
    """Every path on the way down, the file itself last."""
    parts = F.split(rel_path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def _below_any(path: Column, paths: Sequence[str]) -> Column:
    listed = F.array(*[F.lit(p.strip("/")) for p in paths])
    return F.coalesce(F.arrays_overlap(ancestors(F.ltrim(path, F.lit("/"))), listed), F.lit(False))


def apply_path_rules(
    files: DataFrame, paths: Sequence[str], path: str = "rel_path", absolute: str | None = None
) -> DataFrame:
    """Drop files that are, or lie below, one of the given paths.

    A path with a leading slash is compared with column ``absolute``, any other one with ``path``.
    """
    rooted = [p for p in paths if p.startswith("/")]
    relative = [p for p in paths if p.strip("/") and not p.startswith("/")]
    if rooted and absolute is None:
        raise ValueError("absolute rules need the column of absolute paths")
    if relative:
        files = files.where(~_below_any(F.col(path), relative))
    return files.where(~_below_any(F.col(absolute), rooted)) if rooted else files


def _broken(component: Column, path: Column, rules: IgnoreRules, root: Column | None) -> list[tuple[str, Column]]:
    """(reason, test) in the order in which the rules are tried; ``root`` stands before the path."""
    tests = []
    for side in ("directory", "file"):
        exact = rules.directories if side == "directory" else rules.files
        prefixes = getattr(rules, f"{side}_prefix")
        suffixes = getattr(rules, f"{side}_suffix")
        paths = [word.strip("/") for word in exact if not word.startswith("/")]
        here = path.isin(*paths) if paths else F.lit(False)
        if root is not None and rooted(exact):
            here = here | F.concat(root, path).isin(*rooted(exact))
        tests += [
            (f"{side}_name", component.isin(*exact) if exact else F.lit(False)),
            (f"{side}_path", here),
            (f"{side}_prefix", component.rlike(r"\A" + _any_of(prefixes)) if prefixes else F.lit(False)),
            (f"{side}_suffix", component.rlike(_any_of(suffixes) + r"\z") if suffixes else F.lit(False)),
        ]
    return tests


def component_reason(component: Column, path: Column, rules: IgnoreRules, root: Column | None = None) -> Column:
    """The first rule that one component breaks, or null."""
    return F.coalesce(*[F.when(test, reason) for reason, test in _broken(component, path, rules, root)])


def reject_reason(
    rel_path: Column, rules: IgnoreRules, known: Sequence[str], absolute: Column | None = None
) -> Column:
    """Why a file is left out: its topmost bad component, then its extension; ``kept`` otherwise."""
    root = None if absolute is None else _at_root(rel_path, absolute)
    on_the_way = F.transform(
        ancestors(rel_path),
        lambda p: component_reason(F.substring_index(p, "/", -1), p, rules, root),
    )
    first = F.get(F.filter(on_the_way, lambda reason: reason.isNotNull()), F.lit(0))
    ext = extension(rel_path)
    return (
        F.when(ignored(rel_path, rules, absolute), first)
        .when(ext == "", "no_extension")
        .when(~ext.isin(*known), "unknown_extension")
        .otherwise("kept")
    )


def _met_by(components: Column, test: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda pattern: F.exists(components, lambda c: test(c, pattern))


def _tagged(kind: str) -> Callable[[Column], Column]:
    return lambda pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))


def rule_hits(files: DataFrame, rules: IgnoreRules, path: str = "rel_path") -> DataFrame:
    """``(kind, pattern, n_files)`` for every catalog row that any file meets on its way down."""
    components = F.split(F.col(path), "/")
    met = []
    for kind in RULE_KINDS:
        patterns = list(dict.fromkeys(getattr(rules, kind)))
        if not patterns:
            continue
        listed = F.array(*[F.lit(p) for p in patterns])
        if kind in ("directories", "files"):
            hits = F.array_intersect(listed, components)
        else:
            hits = F.filter(listed, _met_by(components, F.startswith if kind.endswith("prefix") else F.endswith))
        met.append(F.transform(hits, _tagged(kind)))
    exploded = files.select(F.explode(F.concat(*met)).alias("rule"))
    return exploded.groupBy("rule.kind", "rule.pattern").agg(F.count(F.lit(1)).alias("n_files"))


def known_extensions_only(files: DataFrame, extensions: DataFrame, name: str = "name") -> DataFrame:
    """Keep files whose extension the catalog holds."""
    keyed = files.withColumn("ext", extension(F.col(name)))
    return keyed.join(broadcast_if_small(extensions.select("ext")), "ext", "left_semi").select(*files.columns)


def tag_language(files: DataFrame, extensions: DataFrame, name: str = "name") -> DataFrame:
    """Add ``lang``; files without a catalogued extension are ``unknown``."""
    keyed = files.withColumn("ext", extension(F.col(name)))
    tagged = keyed.join(broadcast_if_small(extensions.select("ext", "language")), "ext", "left")
    return tagged.select(
        *[c for c in files.columns if c != "lang"],
        F.coalesce("language", F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
    )
