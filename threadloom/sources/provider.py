"""An external provider of structured answers: each prompt asked once, in batches, with retries, a rate limit and a kept answer.

Prompts are known by a hash of model and text. Distinct ones without an answer in the store are
asked, dealt over a stated number of tasks; each task asks in batches, waits between them so
that all tasks together keep the rate, and tries again what failed for a passing reason. Answers
of status OK or INVALID are kept, so that a later run, or a task that is run again after a lost
executor, finds them; errors are not, and are asked again by the next run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.shared import written
from threadloom.sources.store import Store

ANSWERS = "prompt_hash string, status string, value string, attempts int"


class Passing(Exception):
    """A failure that may not come again: worth another try."""


@dataclass(frozen=True)
class Limits:
    batch: int = 16  # prompts in one call
    tasks: int = 4  # that ask at a time
    per_second: float = 0.0  # prompts a second over all tasks; 0: as fast as they come
    attempts: int = 3
    pause: float = 0.5  # seconds before the second try, doubled for each further one


def answered(call: Callable[[list[str]], list], prompts: list[str], limits: Limits) -> list[tuple[str, str | None, int]]:
    """(status, value, attempts) for each prompt of a batch. An answer that isn't an object is INVALID; an exception in its place is an ERROR."""
    out: list[tuple[str, str | None, int] | None] = [None] * len(prompts)
    left = list(range(len(prompts)))
    for attempt in range(1, limits.attempts + 1):
        try:
            got = call([prompts[i] for i in left])
            if len(got) != len(left):
                raise ValueError("the provider gave another number of answers")
        except Exception as error:  # noqa: BLE001  the source must not fail a job
            got = [error] * len(left)
        again = []
        for i, value in zip(left, got, strict=True):
            if isinstance(value, Passing) and attempt < limits.attempts:
                again.append(i)
            elif isinstance(value, Exception):
                out[i] = ("ERROR", json.dumps({"error": type(value).__name__}), attempt)
            elif not isinstance(value, dict):
                out[i] = ("INVALID", json.dumps({"error": "not an object"}), attempt)
            else:
                out[i] = ("OK", json.dumps(value, sort_keys=True), attempt)
        left = again
        if not left:
            break
        time.sleep(limits.pause * 2 ** (attempt - 1))
    return out


def ask(df: DataFrame, prompt: str, call: Callable[[list[str]], list] | None, store: Store | None = None, model: str = "", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """``df`` with status, value (JSON text) and attempts of each row's prompt.

    Without ``call`` nothing is asked: rows without a kept answer are NOT_AVAILABLE. A null prompt
    is one without text. Rows of one prompt share its one answer.
    """
    text = F.coalesce(F.col(prompt).cast("string"), F.lit(""))
    held = df.withColumn("_hash", F.sha2(F.concat(F.lit(f"{model}\n"), text), 256))
    known = store.read() if store is not None else df.sparkSession.createDataFrame([], ANSWERS)
    if call is not None:
        fresh = held.select(F.col("_hash").alias("prompt_hash"), text.alias("text")).distinct().join(known.select("prompt_hash"), "prompt_hash", "left_anti")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gap = limits.batch * limits.tasks / limits.per_second if limits.per_second else 0.0
            due = 0.0
            for f in frames:
                for i in range(0, len(f), limits.batch):
                    some = f.iloc[i : i + limits.batch]
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + gap
                    rows = answered(call, some["text"].tolist(), limits)
                    yield pd.DataFrame({"prompt_hash": some["prompt_hash"], "status": [r[0] for r in rows], "value": [r[1] for r in rows], "attempts": [r[2] for r in rows]})

        asked = written(fresh.repartition(limits.tasks, "prompt_hash").mapInPandas(run, ANSWERS), "answers")
        if store is not None:
            lasting = asked.filter("status <> 'ERROR'")
            if not lasting.isEmpty():
                store.upsert(lasting)
        known = known.unionByName(asked)
    met = held.join(known, held["_hash"] == known["prompt_hash"], "left").drop("_hash", "prompt_hash")
    return met.withColumn("status", F.coalesce("status", F.lit("NOT_AVAILABLE")))


def answer_store(spark, path: str) -> Store:
    """The store of kept answers."""
    return Store(spark, path, "prompt_hash", spark.createDataFrame([], ANSWERS).schema)
