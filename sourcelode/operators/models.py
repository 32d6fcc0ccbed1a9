"""Model stages: a pluggable batch function run inside Spark tasks, and a ledger of what was answered.

A model is a factory without arguments, called once per task (make the client there). It returns a
function that takes a pandas frame ``key, prompt`` and returns a frame ``key, output, tokens, error``.
A model that knows which rows are bad sets their ``error``. One that raises is asked again for each
half, down to the bad row; one that raises ``TryAgain`` is asked again for the same rows, after a pause.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sourcelode.session import bound_batches, broadcast_if_small, checkpoint, measure

BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]
Model = Callable[[], BatchFunction]

EMBEDDING_TYPE = T.ArrayType(T.FloatType())


class TryAgain(Exception):
    """Raised by a model that is busy or out of reach for the moment."""


@dataclass(frozen=True)
class Calls:
    """How a model is called: rows and prompt bytes in one call, attempts on TryAgain, first pause."""

    rows: int = 256
    bytes: int = 1 << 20
    attempts: int = 4
    pause: float = 1.0


def _patiently(fn: BatchFunction, asked: pd.DataFrame, calls: Calls) -> pd.DataFrame:
    """One call; a busy model is asked again after pauses that double."""
    for attempt in range(calls.attempts):
        try:
            return fn(asked)
        except TryAgain:
            if attempt + 1 == calls.attempts:
                raise
            time.sleep(calls.pause * 2**attempt)
    raise ValueError("a model needs one attempt at least")


def _answer(fn: BatchFunction, asked: pd.DataFrame, calls: Calls = Calls()) -> pd.DataFrame:
    """Call the model; when a batch fails, ask in halves so that only bad rows carry an error."""
    try:
        return _patiently(fn, asked, calls)
    except Exception as problem:
        # What was busy to the last attempt would be so for each half as well.
        if len(asked) == 1 or isinstance(problem, TryAgain):
            said = f"{type(problem).__name__}: {problem}"
            return pd.DataFrame({"key": asked["key"], "output": None, "tokens": 0, "error": said})
        half = len(asked) // 2
        parts = [_answer(fn, part, calls) for part in (asked.iloc[:half], asked.iloc[half:])]
        return pd.concat(parts, ignore_index=True)


def _call_ends(prompts: pa.Array, calls: Calls) -> list[int]:
    """Where the calls for a batch end: bounded rows and bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(prompts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    sums, ends, at = np.cumsum(sizes), [], 0
    while at < len(sums):
        before = sums[at - 1] if at else 0
        full = int(np.searchsorted(sums, before + calls.bytes, side="right"))
        at = max(at + 1, min(at + calls.rows, full))
        ends.append(at)
    return ends


def run_model(
    df: DataFrame,
    model: Model,
    prompt: str = "prompt",
    output: str = "output",
    output_type: T.DataType | None = None,
    keep_prompt: bool = False,
    calls: Calls = Calls(),
    partitions: int | None = None,
) -> DataFrame:
    """Add ``output``, ``tokens`` and ``error``. The other columns pass through as Arrow, untouched.

    The result is lazy: checkpoint or write it before using it twice, or the model is asked twice.
    ``partitions`` spreads the rows first, which also sets how many calls run side by side. Rows reach a
    worker in batches of bounded bytes: prompts may be long, and how many a task has grows with the input.
    """
    bound_batches(df.sparkSession)
    answer_type = output_type or T.StringType()
    arrow_type = to_arrow_type(answer_type)
    kept = [c for c in df.columns if keep_prompt or c != prompt]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept])
    schema = schema.add(output, answer_type).add("tokens", T.LongType()).add("error", T.StringType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = model()
        for batch in batches:
            start = 0
            for end in _call_ends(batch.column(prompt), calls):
                part, start = batch.slice(start, end - start), end
                keys = range(part.num_rows)
                asked = pd.DataFrame({"key": keys, "prompt": part.column(prompt).to_pandas()})
                said = _answer(fn, asked, calls).drop_duplicates("key").set_index("key").reindex(keys)
                silent = said["error"].isna() & said["output"].isna()
                error = said["error"].where(~silent, "no reply").astype(object)
                columns = [part.column(c) for c in kept]
                columns.append(pa.array(said["output"].tolist(), arrow_type, from_pandas=True))
                columns.append(pa.array(said["tokens"].fillna(0).astype("int64").to_numpy()))
                columns.append(pa.array(error.tolist(), pa.string(), from_pandas=True))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, output, "tokens", "error"])

    source = df.repartition(partitions) if partitions else df
    return source.mapInArrow(task, schema)


@dataclass(frozen=True)
class Ledger:
    """Answers kept by the digest of the prompt, one Parquet folder per model name.

    Only what is not there yet is asked, equal prompts once, in waves of about ``wave_bytes`` of
    prompts; each wave's answers are written down before the next one is asked, so a job that breaks
    repeats the calls of one wave at the most. Failed calls are not kept.
    """

    path: str
    wave_bytes: int = 1 << 30

    def answers(self, df: DataFrame, name: str, output: str, output_type: T.DataType) -> DataFrame:
        """(digest, output, tokens) of what a model has answered so far."""
        schema = T.StructType().add("digest", "string").add(output, output_type).add("tokens", T.LongType())
        try:
            return df.sparkSession.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return df.sparkSession.createDataFrame([], schema)

    def run_model(
        self,
        df: DataFrame,
        name: str,
        model: Model,
        prompt: str = "prompt",
        output: str = "output",
        output_type: T.DataType | None = None,
        keep_prompt: bool = False,
        calls: Calls = Calls(),
        partitions: int | None = None,
    ) -> DataFrame:
        """As ``run_model`` of this module, but nothing is asked twice of the model called ``name``.

        ``tokens`` of a row is what its answer cost when it was asked. A null prompt is asked anew.
        """
        answer_type = output_type or T.StringType()
        digest = F.sha2(F.coalesce(prompt, F.lit("")), 256)
        wanted = df.select(digest.alias("digest"), F.col(prompt).alias("prompt")).dropDuplicates(["digest"])
        known = self.answers(df, name, output, answer_type).select("digest")
        fresh = checkpoint(wanted.join(known, "digest", "left_anti"), "prompts")
        waves = max(1, math.ceil(measure(fresh)[1] / self.wave_bytes))
        errors = None
        for wave in range(waves):
            mine = fresh.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)
            called = run_model(mine, model, "prompt", output, answer_type, calls=calls, partitions=partitions)
            said = checkpoint(called, "said")
            said.where("error is null").select("digest", output, "tokens").write.mode("append").parquet(f"{self.path}/{name}")
            failed = said.where("error is not null").select("digest", "error")
            errors = failed if errors is None else errors.unionByName(failed)
        # A wave that was broken off while writing may have been asked and written once more.
        held = self.answers(df, name, output, answer_type).dropDuplicates(["digest"])
        kept = [c for c in df.columns if keep_prompt or c != prompt]
        marked = df.withColumn("_digest", digest).select(*kept, "_digest")
        answered = marked.join(held.withColumnRenamed("digest", "_digest"), "_digest", "left")
        failures = broadcast_if_small(errors.withColumnRenamed("digest", "_digest"))
        return answered.join(failures, "_digest", "left").select(
            *kept, output, F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), "error"
        )
