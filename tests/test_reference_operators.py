import os

import pandas as pd
import pytest

from sourcelode.catalogs import IgnoreRules
from sourcelode.functions.replies import parse_split_reply
from sourcelode.operators import changes, filters
from sourcelode.operators.models import _answer
from sourcelode.sources.index_table import IndexTable
from sourcelode.sources.tree import list_tree


def test_rule_hits_name_kind_and_pattern(spark):
    files = spark.createDataFrame([("src/test_a/x.md",), ("target/y",)], "rel_path string")
    rules = IgnoreRules(directories=("target",), file_prefix=("test",), file_suffix=(".md",))
    rows = {(r["kind"], r["pattern"], r["n_files"]) for r in filters.rule_hits(files, rules).collect()}
    assert {("directories", "target", 1), ("file_prefix", "test", 1), ("file_suffix", ".md", 1)} <= rows


def test_point_lookup_has_no_limit_of_its_own(spark):
    index = spark.range(12_000).selectExpr("'p' project", "cast(id as string) file", "0 kind_rank", "0 ord", "'class' code_type")
    assert changes.point_lookup(index, "code_type", "class").count() == 12_000
    assert changes.point_lookup(index, "code_type", "class", 3).count() == 3


def test_a_failing_row_alone_carries_the_error():
    asked_sizes = []

    def model(asked: pd.DataFrame) -> pd.DataFrame:
        asked_sizes.append(len(asked))
        if (asked["prompt"] == "bad").any():
            raise ValueError("no")
        return pd.DataFrame({"key": asked["key"], "output": asked["prompt"], "tokens": 1, "error": None})

    said = _answer(model, pd.DataFrame({"key": range(64), "prompt": ["ok"] * 63 + ["bad"]}))
    assert said["error"].notna().sum() == 1 and len(said) == 64 and len(asked_sizes) == 13


def test_a_looping_link_hides_no_other_entry(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    os.symlink("loop", tmp_path / "loop")
    scan = list_tree(spark, spark.createDataFrame([("p", str(tmp_path))], "project string, root string"))
    assert {r["rel_path"] for r in scan.files.collect()} >= {"a", "b", "c"}


def test_an_index_without_settings_is_not_wiped(spark, tmp_path):
    index = IndexTable.open(spark, str(tmp_path / "i"), 2, 4)
    os.rename(tmp_path / "i" / "settings", tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="no settings"):
        IndexTable.open(spark, index.path, 2, 4)


def test_absolute_path_rules_meet_absolute_paths_only(spark):
    files = spark.createDataFrame(
        [("a/b/x", "/root/p/a/b/x"), ("a/bb/x", "/root/p/a/bb/x"), ("root/p/x", "/root/p/root/p/x"), (None, None)],
        "rel_path string, file string",
    )
    kept = filters.apply_path_rules(files, ("/root/p/a/b", "root/p"), absolute="file")
    assert {r["rel_path"] for r in kept.collect()} == {"a/bb/x", None}
    with pytest.raises(ValueError, match="absolute"):
        filters.apply_path_rules(files, ("/a",))


def test_split_replies_keep_the_code_type(spark):
    raw = '{"classes":[{"name":"A","source_code":"a","code_type":"class"},{"name":"B","source_code":"b"}],"functions":[]}'
    row = parse_split_reply(spark.createDataFrame([(raw,)], "output string")).first()
    assert row["reject"] is None and [c["code_type"] for c in row["reply"]["classes"]] == ["class", None]
