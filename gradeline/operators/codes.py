"""Noise filtering of codes that arrive as rows instead of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import string_list
from ..functions.text import strip
from ..functions.vocab import SIGNALLING, Vocabulary


def filter_noise_rows(
    df: DataFrame, by: list[str], code: str, order_by: list[str], vocab: Vocabulary = SIGNALLING, out: str = "codes"
) -> DataFrame:
    """Labels of every group in order of first appearance, or the default label.

    Rows are reduced to one per group and label in the map tasks, before any list is
    built. A list never holds more than the vocabulary, however many rows a group has.
    """
    cleaned = strip(F.col(code))
    usable = F.lower(cleaned).isin(*vocab.labels)
    if vocab.noise:
        usable = ~F.upper(cleaned).isin(*vocab.noise) & usable
    rows = df.select(*by, *order_by, F.when(usable, F.lower(cleaned)).alias("_label"))
    firsts = rows.groupBy(*by, "_label").agg(F.min(F.struct(*order_by)).alias("_first"))
    entry = F.when(F.col("_label").isNotNull(), F.struct("_first", "_label"))
    lists = firsts.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    labels = F.col("_entries._label")
    return lists.select(*by, F.when(F.size(labels) > 0, labels).otherwise(string_list([vocab.default])).alias(out))


def code_kinds(df: DataFrame, by: list[str], codes: str, vocab: Vocabulary = SIGNALLING) -> DataFrame:
    """How many codes of the lists are labels, noise, or neither; the noise test comes first."""
    code = strip(F.col("_code"))
    kind = F.when(F.lower(code).isin(*vocab.labels), "label").otherwise("unknown")
    if vocab.noise:
        kind = F.when(F.upper(code).isin(*vocab.noise), "noise").otherwise(kind)
    exploded = df.select(*by, F.explode(codes).alias("_code"))
    return exploded.select(*by, kind.alias("kind")).groupBy(*by, "kind").agg(F.count("*").alias("n"))
