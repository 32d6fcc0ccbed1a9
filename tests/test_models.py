import pandas as pd
import pytest
from pyspark.sql import functions as F

from sourcelode.operators.models import Calls, Ledger, TryAgain, _answer, _call_ends, run_model
from sourcelode.session import BATCH_BYTES


def said(asked, output):
    return pd.DataFrame({"key": asked["key"], "output": output, "tokens": 1, "error": None})


def test_a_busy_model_is_asked_again_for_the_same_rows():
    seen = []

    def model(asked):
        seen.append(len(asked))
        if len(seen) < 3:
            raise TryAgain("later")
        return said(asked, asked["prompt"])

    asked = pd.DataFrame({"key": range(5), "prompt": list("abcde")})
    assert _answer(model, asked, Calls(pause=0.0))["error"].isna().all() and seen == [5, 5, 5]


def test_a_model_busy_to_the_end_fails_its_rows_without_halving():
    seen = []

    def model(asked):
        seen.append(len(asked))
        raise TryAgain("later")

    answer = _answer(model, pd.DataFrame({"key": range(4), "prompt": list("abcd")}), Calls(attempts=2, pause=0.0))
    assert seen == [4, 4] and answer["error"].tolist() == ["TryAgain: later"] * 4


def test_calls_are_cut_by_rows_and_bytes():
    import pyarrow as pa

    prompts = pa.array(["aa", "bbbb", None, "c", "d" * 50, "e", "f"])
    assert _call_ends(prompts, Calls(rows=3, bytes=6)) == [3, 4, 5, 7]
    assert _call_ends(prompts.slice(0, 0), Calls()) == []


@pytest.fixture
def counted(spark):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def fn(asked):
            calls.add(len(asked))
            bad = asked["prompt"] == "bad"
            frame = said(asked, asked["prompt"].str.upper())
            frame["error"] = bad.map({True: "no", False: None})
            return frame

        return fn

    return calls, model


def test_the_ledger_asks_each_prompt_once(spark, tmp_path, counted):
    calls, model = counted
    ledger = Ledger(str(tmp_path / "ledger"), wave_bytes=100)
    rows = [(i, f"p{i % 7}") for i in range(40)] + [(90, "bad"), (91, None)]
    frame = spark.createDataFrame(rows, "id int, prompt string")

    def run(df):
        return {r["id"]: (r["output"], r["error"]) for r in ledger.run_model(df, "m", model).collect()}

    first = run(frame)
    assert calls.value == 9 and len(first) == 42 and first[3] == ("P3", None) and first[90] == (None, "no")
    assert run(frame.where("prompt != 'bad'").select("prompt", "id"))[39] == ("P4", None) and calls.value == 9
    assert run(frame.where("id = 90")) == {90: (None, "no")} and calls.value == 10
    assert run(frame.withColumn("prompt", F.concat("prompt", F.lit("!"))).where("id < 7"))[0] == ("P0!", None)
    assert calls.value == 17


def test_run_model_keeps_other_columns(spark, counted):
    _, model = counted
    frame = spark.createDataFrame([(2**53 + 1, "a"), (None, "bad")], "id bigint, prompt string").coalesce(1)
    found = run_model(frame, model).collect()
    assert {(r["id"], r["output"], r["error"]) for r in found} == {(2**53 + 1, "A", None), (None, "BAD", "no")}


def test_workers_are_sent_bounded_bytes_at_once(spark):
    def model():
        return lambda batch: pd.DataFrame({"key": batch["key"], "output": [str(len(batch))] * len(batch), "tokens": 0, "error": None})

    long = spark.range(0, 200, 1, 1).selectExpr("id", "concat(id, repeat('x', 262144)) as prompt")
    whole = Calls(rows=1 << 30, bytes=1 << 40)
    said = run_model(long, model, calls=whole).select("id", "output", "error").collect()
    assert sorted(r["id"] for r in said) == list(range(200)) and not any(r["error"] for r in said)
    assert max(int(r["output"]) for r in said) * 262144 < 2 * BATCH_BYTES
