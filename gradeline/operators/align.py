"""Pairing predictions with gold examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import stage
from .sequence import dense_ordinals, file_ordinals


def align_by_id(gold: DataFrame, preds: DataFrame, key: str = "ex_id", strict: bool = False) -> DataFrame:
    """Pair on the example id; predictions without a gold row are left out, or an error with ``strict``.

    All runs go through one join. Project both sides to labels first: then only ids
    and labels travel, never texts. The planner picks the join by the sizes it knows and sees at run time; no id can
    become hot, as it occurs once per run. :func:`unpaired` counts what finds no gold row.
    """
    if not strict:
        return preds.join(gold, key)
    marked = preds.join(gold.withColumn("_gold", F.lit(True)), key, "left")
    message = F.concat(F.lit("no gold row for "), F.col(key).cast("string"))
    return marked.withColumn("_gold", F.when(F.col("_gold"), True).otherwise(F.raise_error(message))).filter("_gold").drop("_gold")


def unpaired(gold: DataFrame, preds: DataFrame, run: list[str], key: str = "ex_id") -> DataFrame:
    """Rows of every run, and how many of them have no gold row. Of both sides only ids travel."""
    known = gold.select(key).distinct().withColumn("_known", F.lit(True))
    joined = preds.select(*run, key).join(known, key, "left")
    return joined.groupBy(*run).agg(F.count("*").alias("n_rows"), F.count_if(F.col("_known").isNull()).alias("n_unpaired"))


def align_by_position(
    gold: DataFrame, preds: DataFrame, gold_order: list[str], pred_order: list[str], run: list[str]
) -> DataFrame:
    """Pair by position, for predictions without ids.

    A run that is shorter than the gold set misses its first examples (they were
    shown to the model as few-shot examples). A longer run is an error.
    """
    numbered_gold = dense_ordinals(gold, gold_order, name="gold_ord")
    n_gold = numbered_gold.agg(F.count("*")).scalar()
    # Finding the ranges reads the rows one more time: labels are cheap to read again, extraction is not.
    numbered = dense_ordinals(stage(preds, "labels"), pred_order, within=run, name="pred_ord", total="n_pred")
    return _shifted(numbered, numbered_gold, n_gold, run)


def align_in_file_order(gold: DataFrame, preds: DataFrame, run: list[str]) -> DataFrame:
    """Pair lines of files without ids by position, see :func:`align_by_position`.

    Both sides come from :func:`..sources.jsonl.read_lines_in_order` with their labels; they lie in order already, so they
    are numbered without a sort.
    """
    numbered_gold = file_ordinals(stage(gold, "gold"), name="gold_ord").drop("file", "block", "line")
    n_gold = numbered_gold.agg(F.count("*")).scalar()
    numbered = file_ordinals(stage(preds, "labels"), within=run, name="pred_ord", total="n_pred").drop("file", "block", "line")
    return _shifted(numbered, numbered_gold, n_gold, run)


def _shifted(numbered: DataFrame, numbered_gold: DataFrame, n_gold: Column, run: list[str]) -> DataFrame:
    offset = n_gold - F.col("n_pred")
    message = F.concat(F.lit("more predictions than gold rows: "), F.concat_ws("/", *run))
    placed = numbered.withColumn(
        "gold_ord", F.when(offset < 0, F.raise_error(message)).otherwise(F.col("pred_ord") + offset)
    )
    return placed.join(numbered_gold, "gold_ord").drop("n_pred")


def shots_in(strategy: Column) -> Column:
    """Number of few-shot examples of a strategy name."""
    return F.when(F.contains(strategy, F.lit("five")), 5).otherwise(0)


def uses_reasoning(strategy: Column) -> Column:
    """Does the strategy ask for step-by-step reasoning?"""
    return F.contains(strategy, F.lit("cot"))


def first_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first n rows in order; every task keeps only its own n."""
    return df.orderBy(*order_by).limit(n)


def split_shots(df: DataFrame, n: int, order_by: list[str], key: str = "ex_id") -> tuple[DataFrame, DataFrame]:
    """Few-shot examples (the first n rows) and the remaining rows, which are the ones to evaluate."""
    shots = first_rows(df, n, order_by)
    ids = shots.select(key)
    return shots, df.join(ids, key, "left_anti")


def shot_list(shots: DataFrame, order_by: list[str], log: str = "log", codes: str = "root_cause") -> Column:
    """The few-shot examples as one constant array column, in order.

    Meant for the output of :func:`first_rows`: the array holds n rows.
    """
    entry = F.struct(*order_by, F.col(log).alias("log"), F.col(codes).alias("root_cause"))
    return shots.agg(F.sort_array(F.collect_list(entry))).scalar()
