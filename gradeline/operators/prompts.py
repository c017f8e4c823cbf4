"""Prompts, chat messages and fine-tuning pairs as column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates as T
from ..functions.text import json_string_list
from ..functions.vocab import SIGNALLING, Vocabulary


def fill(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` marks replaced by columns."""
    parts: list[str | Column] = [template]
    for name, value in values.items():
        mark, filled = "{" + name + "}", []
        for part in parts:
            if not isinstance(part, str):
                filled.append(part)
                continue
            for i, text in enumerate(part.split(mark)):
                filled += [value, text] if i else [text]
        parts = filled
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts if not isinstance(p, str) or p])


def instruction_prompt(log: Column) -> Column:
    return fill(T.INSTRUCTION_PROMPT, log=log)


def chat_prompt(log: Column, reasoning: bool = True) -> Column:
    system = T.CHAT_SYSTEM if reasoning else T.CHAT_SYSTEM + T.NO_REASONING
    return fill(T.CHAT_PROMPT, system=F.lit(system), log=log)


def training_pairs(
    examples: DataFrame, model: Column, keep: Sequence[str] = (), chat_models: tuple[str, ...] = T.CHAT_MODELS
) -> DataFrame:
    """``prompt`` and ``completion`` of every example, in the format of the model; other columns are dropped."""
    is_chat, log, answer = model.isin(*chat_models), F.col("log"), json_string_list(F.col("root_cause"))
    return examples.select(
        *keep,
        F.when(is_chat, chat_prompt(log)).otherwise(instruction_prompt(log)).alias("prompt"),
        F.when(is_chat, F.concat(answer, F.lit(T.CHAT_END))).otherwise(answer).alias("completion"),
    )


def inference_prompt(log: Column, model: Column, chat_models: tuple[str, ...] = T.CHAT_MODELS) -> Column:
    """The prompt to answer; chat models are told not to reason, which training prompts do not say."""
    return F.when(model.isin(*chat_models), chat_prompt(log, reasoning=False)).otherwise(instruction_prompt(log))


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(F.struct(text.alias("text"))).alias("content"))


def shot_turns(shots: DataFrame, order_by: list[str], log: str = "log", codes: str = "root_cause") -> Column:
    """User and assistant turns of the few-shot examples, in order, as one constant array column.

    The turns are built once, from the few rows of :func:`gradeline.operators.align.first_rows`,
    and reach the other rows as a constant: no join, no shuffle.
    """
    pair = F.array(_turn("user", F.col(log)), _turn("assistant", json_string_list(F.col(codes))))
    rows = shots.agg(F.sort_array(F.collect_list(F.struct(*order_by, pair.alias("pair")))).alias("rows"))
    return rows.select(F.flatten("rows.pair")).scalar()


def chat_messages(log: Column, turns: Column | None, reasoning: Column) -> Column:
    """The turns of the few-shot examples, then the user turn to answer."""
    question = _turn("user", F.concat(log, F.when(reasoning, T.REASONING_SUFFIX).otherwise("")))
    return F.array(question) if turns is None else F.concat(turns, F.array(question))


def hosted_request(messages: Column, system: str = T.HOSTED_SYSTEM) -> Column:
    """What a hosted model is sent: its standing instruction and the messages of :func:`chat_messages`."""
    return F.struct(F.array(F.struct(F.lit(system).alias("text"))).alias("system"), messages.alias("messages"))


def generation_prompt(label: Column, vocab: Vocabulary = SIGNALLING, scenarios: dict[str, str] = T.SCENARIOS) -> Column:
    """The request for one synthetic example of a label."""
    pairs = F.create_map(*[F.lit(x) for pair in scenarios.items() for x in pair])
    labels = F.lit(json.dumps(list(vocab.labels)))
    return fill(T.GENERATION_CONTRACT, scenario=F.try_element_at(pairs, label), labels=labels, label=label)
