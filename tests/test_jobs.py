import json
import re
from dataclasses import replace

import pandas as pd
import pytest

from sourcelode.functions import local_models
from sourcelode.functions.replies import parse_route_reply
from sourcelode.operators.models import EMBEDDING_TYPE, Ledger, run_model
from sourcelode.plans import jobs
from sourcelode.plans.relations import LOCAL
from sourcelode.schema import FILES, SUMMARY_FILE
from sourcelode.session import fresh_path, list_folders, shared_dir
from sourcelode.sources.index_table import IndexTable


def listing(spark, *files):
    rows = [(p, f"/{p}/{f}", f"/{p}/{f}", "Python", text, f"md5 of {text}", True) for p, f, text in files]
    return spark.createDataFrame(rows, FILES)


def counting(spark, model):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        fn = model()

        def run(batch):
            calls.add(len(batch))
            return fn(batch)

        return run

    return calls, factory


def files_of(index):
    return {r["file"] for r in index.rows().collect()}


def test_a_broken_rebuild_goes_on_without_asking_again(spark, monkeypatch):
    calls, analyse = counting(spark, local_models.analyse)
    models = replace(LOCAL, analyse=analyse, ledger=Ledger(fresh_path(spark, "ledger")))
    files = listing(spark, *[("p", f"{n}.py", f"text {n}") for n in range(6)])
    index = IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim)
    with monkeypatch.context() as patched, pytest.raises(OSError, match="killed"):
        patched.setattr(jobs, "summary_rows", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        jobs.rebuild_index(index, files, models)
    assert files_of(index) == set() and calls.value == 6
    report = jobs.rebuild_index(index, files, models)
    assert calls.value == 6 and report.changed == 6
    assert files_of(index) == {f"/p/{n}.py" for n in range(6)} | {SUMMARY_FILE}


def test_a_project_with_a_failed_file_is_reported_and_keeps_its_summary(spark):
    def analyse():
        fn = local_models.analyse()

        def run(batch):
            said = fn(batch)
            bad = batch["prompt"].str.contains("broken")
            said.loc[bad, "error"] = "refused"
            return said.assign(output=said["output"].where(~bad, None))

        return run

    models = replace(LOCAL, analyse=analyse)
    index = IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim)
    jobs.rebuild_index(index, listing(spark, ("p", "a", "one"), ("q", "a", "two")), models)

    def summaries():
        return {r["project"]: r["purpose"] for r in index.rows().where(f"file = '{SUMMARY_FILE}'").collect()}

    before = summaries()
    changed = listing(spark, ("p", "a", "one"), ("p", "b", "broken"), ("q", "a", "three"), ("q", "b", "four"))
    report = jobs.refresh_index(index, changed, models)
    assert [tuple(r) for r in report.unsummarised.collect()] == [("p", 1)]
    assert [(r["file"], r["stage"], r["reason"]) for r in report.rejects.collect()] == [("/p/b", "analyse", "refused")]
    after = summaries()
    assert after["p"] == before["p"] and after["q"] != before["q"] and set(after) == {"p", "q"}
    assert report.usage.count() == 2


def test_a_job_leaves_no_scratch_behind(spark):
    def steps():
        return {f for f in list_folders(spark, shared_dir(spark)) if f.startswith(("described", "vectors", "step", "status", "changed"))}

    index = IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim)
    before = steps()
    jobs.refresh_index(index, listing(spark, ("p", "a", "one")), LOCAL)
    assert steps() == before and files_of(index) == {"/p/a", SUMMARY_FILE}


def test_many_deltas_are_compacted(spark):
    index = IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim)
    for n in range(3):
        jobs.refresh_index(index, listing(spark, ("p", "a", f"text {n}")), LOCAL, compact_after=2)
    assert len(index.live()) <= 2 and files_of(index) == {"/p/a", SUMMARY_FILE}


def test_route_replies_are_read_strictly(spark):
    good = {"related_files": [{"file": "a", "reason": "r", "more": 1}, {"file": "b", "reason": ""}]}
    replies = [
        (json.dumps(good), None), ("```json\n" + json.dumps(good) + "\n```", None), ('{"related_files": []}', None), ("no", "not_json"),
        ('{"files": []}', "bad_related_files"), ('{"related_files": [{"file": 1, "reason": "r"}]}', "bad_related_files_entry"),
        ('{"related_files": [{"file": "a"}]}', "bad_related_files_entry"), ('{"related_files": "a"}', "bad_related_files"), (None, "not_json"),
    ]
    parsed = parse_route_reply(spark.createDataFrame(replies, "output string, wanted string")).collect()
    assert all(r["reject"] == r["wanted"] for r in parsed)
    assert [x["file"] for x in parsed[0]["related"]] == ["a", "b"] and parsed[2]["related"] == []


def routed(spark, reply):
    index = IndexTable.open(spark, fresh_path(spark, "index"), LOCAL.dim)
    jobs.rebuild_index(index, listing(spark, *[("p", f"{n}.py", f"text {n}") for n in range(4)]), LOCAL)

    def route():
        return lambda batch: pd.DataFrame({"key": batch["key"], "output": reply, "tokens": 1, "error": None})

    def answer():
        return lambda batch: pd.DataFrame({"key": batch["key"], "output": batch["prompt"], "tokens": 1, "error": None})

    models = replace(LOCAL, route=route, answer=answer)
    queries = spark.createDataFrame([(1, "which?")], "query_id bigint, query string")
    return jobs.routed_ask(index.rows(), queries, models, max_files=2, k=100).collect()[0]


def test_routed_asking_takes_offered_files_once_in_order(spark):
    named = ["/p/2.py", "/no", "/p/2.py", "/p/0.py", "/p/1.py", "/nor"]
    row = routed(spark, json.dumps({"related_files": [{"file": f, "reason": "r"} for f in named]}))
    assert (row["n_files"], row["n_unknown"], row["error"]) == (2, 2, None)
    assert re.findall(r"^//file (/\S+)", row["output"], re.M) == ["/p/2.py", "/p/0.py"]


def test_routed_asking_reports_an_unusable_reply(spark):
    row = routed(spark, '{"related_files": 7}')
    assert row["error"] == "bad_related_files" and row["output"] is None


def test_texts_are_split_only_when_the_model_rejects_them(spark):
    limit = local_models.CONTEXT_BYTES
    texts = [("short", "a\n" * 10), ("long", "b" * 100 + "\n" + ("c" * 100 + "\n") * 200), ("stuck", "d" * limit), ("edge", "e" * (limit - 1))]
    frame = spark.createDataFrame(texts, "name string, text string")
    models = replace(LOCAL, embed=local_models.embed_in_context, split_when="rejected")
    found = {r["name"]: r for r in jobs.embed_texts(frame, ["name"], "text", models).collect()}
    assert found["short"]["n_chunks"] == found["edge"]["n_chunks"] == 1 and found["long"]["n_chunks"] == 3
    assert found["stuck"]["error"] == "over the maximum context length" and found["stuck"]["embedding"] is None
    plain = run_model(frame.where("name = 'edge'"), LOCAL.embed, "text", "embedding", EMBEDDING_TYPE).first()
    assert found["edge"]["embedding"] == plain["embedding"]
