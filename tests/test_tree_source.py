import os
import time

import pytest

from sourcelode.catalogs import NO_RULES, IgnoreRules
from sourcelode.plans.jobs import refresh_index
from sourcelode.plans.relations import LOCAL
from sourcelode.session import fresh_path
from sourcelode.sources.index_table import IndexTable
from sourcelode.sources.tree import scan_files
from sourcelode.sources.tree_source import Tree, _options, read_tree, stream_tree
from sourcelode.streaming.refresh import refresh_from

RULES = IgnoreRules(("node_modules", "deep/cut"), ("tmp",), (), (), (), (".min.py",))


@pytest.fixture
def root(tmp_path):
    home = tmp_path / "trees"
    for path in (
        "p/a.py", "p/deep/b.rs", "p/deep/cut/c.py", "p/deep/deeper/d.py", "p/node_modules/e.py", "p/tmp1/f.py", "p/g.min.py",
        "p/_h.py", "p/.i.py", "q/a.py", "q/readme.txt", "q/none",
    ):
        (home / path).parent.mkdir(parents=True, exist_ok=True)
        (home / path).write_text(f"text of {path}")
    (home / "q/bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside/o.py").write_text("outside")
    os.symlink(tmp_path / "outside", home / "q/linked")
    os.symlink(home / "q", tmp_path / "outside/back")
    os.symlink(home / "p/deep", home / "p/again")
    os.symlink("loop", home / "p/loop.py")
    return home


WANTED = {
    ("p", "a.py"), ("p", "deep/b.rs"), ("p", "deep/deeper/d.py"), ("p", "_h.py"), ("p", ".i.py"), ("q", "a.py"), ("q", "bad.py"),
    ("q", "linked/o.py"),
}


@pytest.mark.parametrize("folders", [1, 3, None])
def test_the_source_reads_what_the_rules_leave(spark, root, folders):
    rows = read_tree(spark, str(root), RULES, folders=folders).collect()
    assert {(r["project"], r["rel_path"]) for r in rows} == WANTED and len(rows) == len(WANTED)
    bad = next(r for r in rows if r["rel_path"] == "bad.py")
    assert bad["text"] == "" and not bad["decode_ok"]
    assert {r["lang"] for r in rows if r["rel_path"].endswith(".rs")} == {"Rust"}


def test_source_and_walk_agree(spark, root):
    projects = spark.createDataFrame([(p, str(root / p)) for p in "pq"], "project string, root string")
    (root / "p/loop.py").unlink()  # the walk reports a link that leads nowhere as a file without text
    columns = ["project", "file", "lang", "md5", "decode_ok"]
    walked = {tuple(r) for r in scan_files(spark, projects, RULES).files.select(*columns).collect()}
    assert walked == {tuple(r) for r in read_tree(spark, str(root), RULES).select(*columns).collect()}


def test_absolute_rules_bar_one_place_only(spark, root):
    rules = IgnoreRules((str(root / "p/deep"),), (), (), (str(root / "q/a.py"),), (), ())
    paths = {(r["project"], r["rel_path"]) for r in read_tree(spark, str(root), rules).collect()}
    assert ("p", "a.py") in paths and ("q", "a.py") not in paths and not any(rel.startswith("deep/") for _, rel in paths)
    projects = spark.createDataFrame([(p, str(root / p)) for p in "pq"], "project string, root string")
    walked = {(r["project"], r["rel_path"]) for r in scan_files(spark, projects, rules).files.collect()}
    assert ("q", "a.py") not in walked and ("p", "a.py") in walked and not any(rel.startswith("deep/") for _, rel in walked)


def test_planning_stops_at_enough_pieces(root):
    for folders in (1, 4, 256):
        pieces = Tree(_options(str(root), RULES, folders=folders)).plan()
        assert {(p.project, p.rel_path) for p in pieces if p.deep} | {(p.project, p.rel_path) for p in pieces if not p.deep}
        assert any(p.deep for p in pieces) == (folders < 256)


def test_a_stream_sees_a_new_file_once_and_a_changed_one_again(spark, root, tmp_path):
    seen, progress, out = [], str(tmp_path / "progress"), lambda batch, _: seen.extend((f"{r['project']}/{r['rel_path']}", r["text"]) for r in batch.collect())

    def run():
        seen.clear()
        time.sleep(0.05)
        stream = stream_tree(spark, str(root), NO_RULES, lag=0.0)
        stream.writeStream.foreachBatch(out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        return sorted(seen)

    assert len(run()) > 8 and run() == []
    (root / "p/new.py").write_text("new")
    (root / "q/a.py").write_text("changed")
    assert run() == [("p/new.py", "new"), ("q/a.py", "changed")] and run() == []


def test_streamed_and_batch_refreshes_end_alike(spark, root):
    streamed, batch = (IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim) for _ in range(2))
    progress = fresh_path(spark, "progress")

    def state(index):
        return sorted((r["project"], r["file"], r["kind_rank"], r["ord"], r["md5"], r["purpose"]) for r in index.rows().collect())

    for step in range(2):
        refresh_from(stream_tree(spark, str(root), RULES, lag=0.0), streamed, LOCAL, progress).awaitTermination()
        report = refresh_index(batch, read_tree(spark, str(root), RULES), LOCAL)
        assert state(streamed) == state(batch) and report.changed == (len(WANTED) if not step else 2)
        (root / "p/a.py").write_text("other")
        (root / "p/new.py").write_text("new")
        time.sleep(0.05)
    before = len(batch.log())
    refresh_index(batch, read_tree(spark, str(root), RULES), LOCAL)
    written = len(batch.log())
    refresh_index(batch, read_tree(spark, str(root), RULES), LOCAL)
    assert written == before and len(batch.log()) == before
    (root / "q/a.py").unlink()
    report = refresh_index(batch, read_tree(spark, str(root), RULES), LOCAL, prune=True)
    assert report.removed == 1 and not [r for r in state(batch) if r[1].endswith("q/a.py")]


def test_reading_passes_on_a_few_megabytes_at_once(tmp_path):
    import pandas as pd

    from sourcelode.sources.tree import _read_files

    paths = [tmp_path / f"{i}.py" for i in range(12)]
    for path in paths:
        path.write_bytes(b"x" * (1 << 20))
    parts = list(_read_files(iter([pd.DataFrame({"file": [str(path) for path in paths]})])))
    assert [len(data) for part in parts for data in part["bytes"]] == [1 << 20] * 12
    assert max(sum(len(data) for data in part["bytes"]) for part in parts) <= 5 << 20


def test_a_wide_project_is_shared_out_evenly(tmp_path):
    for project, n in (("wide", 300), ("broad", 200), ("flat", 2)):
        for i in range(n):
            folder = tmp_path / project / f"m{i}" / "src"
            folder.mkdir(parents=True)
            (folder / "a.py").write_text(f"{project}{i}")
        (tmp_path / project / "top.py").write_text(project)
    tree = Tree({"path": str(tmp_path), "folders": "16"})
    pieces = tree.plan()
    read = [[row[3] for row in tree.read(piece)] for piece in pieces]
    every = [path for paths in read for path in paths]
    assert len(every) == len(set(every)) == 505
    assert len(pieces) <= 3 * 16 and max(map(len, read)) < 60
