"""Batch prediction with a pluggable function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Predictor = Callable[[list[str]], list[str]]

#: Answers that a worker gathers before it hands them back.
ANSWERS_OUT = 1000


def predict_batches(
    df: DataFrame, make: Callable[[], Predictor], prompt: str = "prompt", batch_size: int = 4, default_answer: str = '["normal"]'
) -> DataFrame:
    """Add ``output`` (the raw answer) and ``defaulted`` (the call failed) to every row.

    ``make`` is called once per task and returns the predictor, so a model is loaded once, in the worker. Only the
    prompts go to the worker. The predictor sees the prompts of a task in batches of at most ``batch_size``. A batch that fails is
    answered with the default and marked, so that the share of failures stays visible; a task of which every batch
    fails (two at least) is an error with the cause of the last failure. Rows never leave their partition, and a lost task is
    repeated. A worker holds Arrow batches of prompts, which Spark bounds in bytes (the one at work and the next), Python strings of
    ``batch_size`` prompts only, and at most ``ANSWERS_OUT`` answers besides those of a call.
    """

    def handed_back(answers: list, defaulted: list[bool]) -> pa.Array:
        output = pa.array(answers, pa.string(), from_pandas=True)
        return pa.StructArray.from_arrays([output, pa.array(defaulted, pa.bool_())], ["output", "defaulted"])

    @F.arrow_udf("output string, defaulted boolean")
    def answer(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = make()
        failures = batches = 0
        cause = None
        for column in columns:
            answers, defaulted = [], []
            for start in range(0, len(column), batch_size):
                batch = column.slice(start, batch_size).to_pylist()
                try:
                    got = list(predictor(batch))
                    if len(got) != len(batch):
                        raise ValueError(f"{len(got)} answers to {len(batch)} prompts")
                    failed = False
                except Exception as error:  # noqa: BLE001 - a failed call is an answer of its own kind
                    got, failed, cause = [default_answer] * len(batch), True, error
                batches, failures = batches + 1, failures + failed
                answers += got
                defaulted += [failed] * len(batch)
                if len(answers) >= ANSWERS_OUT:
                    yield handed_back(answers, defaulted)
                    answers, defaulted = [], []
            if answers:
                yield handed_back(answers, defaulted)
        if batches > 1 and failures == batches:
            raise RuntimeError("every batch of the task failed") from cause

    answered = df.withColumn("_answer", answer(F.col(prompt)))
    return answered.select(*df.columns, "_answer.output", "_answer.defaulted")


def phrase_predictor(rules: list[tuple[str, str]], default: str) -> Predictor:
    """A predictor that needs no model: the label of the first phrase that occurs, as a JSON list."""
    compiled = [(re.compile(pattern, re.IGNORECASE), label) for pattern, label in rules]

    def predict(prompts: list[str]) -> list[str]:
        labels = (next((label for rule, label in compiled if rule.search(p)), default) for p in prompts)
        return [f'["{label}"]' for label in labels]

    return predict
