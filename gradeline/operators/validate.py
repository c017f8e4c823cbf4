"""Validation of generated records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import primary_label
from ..functions.text import strip_fence
from ..functions.vocab import Vocabulary
from ..sources.jsonl import allow_repeated_keys


def parse_records(
    df: DataFrame, text: str = "generated", vocab: Vocabulary | None = None, expected: str | None = None
) -> DataFrame:
    """Add ``record`` (the JSON text), ``log``, ``root_cause`` and ``reason`` (null for a valid record).

    A record is a JSON object with the keys ``log`` and ``root_cause``, the latter a
    list that is not empty. ``root_cause`` has the texts of that list; ``record`` keeps all of it, and all other keys.
    With ``vocab`` and ``expected`` the label is also compared with the one that was asked for. A lone surrogate in
    a record becomes a question mark. Of a repeated key, at any depth, the last value counts. Columns of the input with the names of
    the four results give way to them.

    The results come out of a generator, so that a filter on them is not moved into the parse, which would then run
    once per test.
    """
    allow_repeated_keys(df.sparkSession)
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("record", "log", "root_cause", "reason")]
    fenced_off = df.withColumn("record", strip_fence(F.col(text)))
    # A JSON reader stops after the first value. The closing element shows that nothing followed the record.
    seal = F.xxhash64("record").cast("string")
    wrapped = F.concat(F.lit("["), F.col("record"), F.lit(',{"root_cause":"'), seal, F.lit('"}]'))
    parsed = F.from_json(wrapped, "array<struct<log variant, root_cause variant>>", {"allowSingleQuotes": "false"})
    staged = fenced_off.withColumn("_seal", seal).withColumn("_parsed", parsed)
    closing = F.try_variant_get(F.try_element_at("_parsed", F.lit(2))["root_cause"], "$", "string")
    # The reader passes over a broken value inside a record; the count of elements needs all of it to be JSON.
    sound = F.json_array_length(F.concat(F.lit("["), F.col("record"), F.lit("]"))) == 1
    whole = sound & (F.size("_parsed") == 2) & (closing == F.col("_seal"))
    staged = staged.withColumn("_r", F.when(whole, F.try_element_at("_parsed", F.lit(1))))
    codes = F.col("_r.root_cause")
    items = F.try_variant_get(codes, "$", "array<variant>")
    texts = F.filter(
        F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))),
        lambda s: s.isNotNull(),
    )
    reason = (
        F.when(F.col("_r").isNull(), "not a JSON object")
        .when(F.col("_r.log").isNull() | codes.isNull(), "missing key")
        .when(~F.schema_of_variant(codes).startswith("ARRAY"), "root_cause is not a list")
        .when(F.size(items) == 0, "root_cause is empty")
    )
    log = F.try_variant_get(F.col("_r.log"), "$", "string")
    found = F.struct(F.col("record"), log.alias("log"), texts.alias("root_cause"), reason.alias("reason"))
    result = staged.select(*others, F.inline(F.array(found)))
    if vocab is not None and expected is not None:
        other = F.col("reason").isNull() & (primary_label(F.col("root_cause"), vocab) != F.col(expected))
        result = result.withColumn("reason", F.when(other, "label differs").otherwise(F.col("reason")))
    return result


def valid_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull())


def quarantine_report(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Skipped records by class and reason."""
    return quarantined(parsed).groupBy(*by, "reason").agg(F.count("*").alias("n_skipped"))


def written_and_skipped(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Records kept and skipped."""
    return parsed.groupBy(*by).agg(
        F.count_if(F.col("reason").isNull()).alias("written"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped"),
    )
