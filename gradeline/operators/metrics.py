"""Scores of classification runs, all derived from one distributed confusion matrix.

The matrix is the only shuffle of prediction rows, and it is pre-aggregated in the
map tasks: a run sends at most (labels x labels) cells per task, however its
predictions are distributed. Everything after it works on those cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import primary_label
from ..functions.text import ratio
from ..functions.vocab import SIGNALLING, Vocabulary

RUN = ["model", "strategy"]


def with_primary_labels(
    df: DataFrame, gold_codes: str, predicted_codes: str, vocab: Vocabulary = SIGNALLING
) -> DataFrame:
    """Replace both label lists by their primary labels ``gold`` and ``pred``."""
    return df.select(
        *[c for c in df.columns if c not in (gold_codes, predicted_codes)],
        primary_label(F.col(gold_codes), vocab).alias("gold"),
        primary_label(F.col(predicted_codes), vocab).alias("pred"),
    )


def confusion_matrix(df: DataFrame, run: list[str] = RUN) -> DataFrame:
    """Rows per (run, gold, pred)."""
    return df.groupBy(*run, "gold", "pred").agg(F.count("*").alias("n"))


def label_counts(cells: DataFrame, run: list[str] = RUN, labels: tuple[str, ...] = SIGNALLING.labels) -> DataFrame:
    """True positives, predictions and support of every label that occurs in a run."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("gold").alias("label"), hit.alias("tp"), none.alias("pp"), F.col("n").alias("n")),
        F.struct(F.col("pred").alias("label"), none.alias("tp"), F.col("n").alias("pp"), none.alias("n")),
    )
    return (
        cells.select(*run, F.inline(sides))
        .filter(F.col("label").isin(*labels))
        .groupBy(*run, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("n").alias("n"))
    )


def score_columns(tp: Column, predicted: Column, support: Column) -> dict[str, Column]:
    """F1, precision and recall from counts; 0 where a ratio has nothing to divide by."""
    return {
        "f1": ratio(2 * tp, predicted + support),
        "precision": ratio(tp, predicted),
        "recall": ratio(tp, support),
    }


def per_class(cells: DataFrame, run: list[str] = RUN, labels: tuple[str, ...] = SIGNALLING.labels) -> DataFrame:
    """One-against-rest scores of every label that has gold rows in the run."""
    counts = label_counts(cells, run, labels).filter("n > 0")
    scores = score_columns(F.col("tp"), F.col("pp"), F.col("n"))
    return counts.select(*run, "label", "tp", "pp", "n", *[c.alias(k) for k, c in scores.items()])


def overall(cells: DataFrame, run: list[str] = RUN, labels: tuple[str, ...] = SIGNALLING.labels) -> DataFrame:
    """Micro-averaged scores over the label set, and the share of equal primary labels."""
    counts = cells.groupBy(*run).agg(*_run_sums(labels))
    return counts.select(*run, *_run_scores())


def _run_sums(labels: tuple[str, ...]) -> list[Column]:
    same, n = F.col("gold") == F.col("pred"), F.col("n")
    in_gold, in_pred = F.col("gold").isin(*labels), F.col("pred").isin(*labels)
    zero = F.lit(0).cast("bigint")
    return [
        F.sum(F.when(same & in_gold, n).otherwise(zero)).alias("tp"),
        F.sum(F.when(in_pred, n).otherwise(zero)).alias("pp"),
        F.sum(F.when(in_gold, n).otherwise(zero)).alias("support"),
        F.sum(F.when(same, n).otherwise(zero)).alias("n_correct"),
        F.sum(n).alias("n"),
    ]


def _run_scores() -> list[Column]:
    scores = score_columns(F.col("tp"), F.col("pp"), F.col("support"))
    exact = ratio(F.col("n_correct"), F.col("n"))
    return [*[c.alias(k) for k, c in scores.items()], exact.alias("exact_match"), "n_correct", "n"]


def averages(classes: DataFrame, run: list[str] = RUN) -> DataFrame:
    """Macro and support-weighted averages of the unrounded per-class scores."""

    def exact(numerator: Column, denominator: Column) -> Column:
        return F.coalesce(numerator / F.when(denominator != 0, denominator), F.lit(0.0))

    tp, pp, n = F.col("tp"), F.col("pp"), F.col("n")
    raw = classes.select(
        *run, "n", exact(2 * tp, pp + n).alias("f"), exact(tp, pp).alias("p"), exact(tp, n).alias("r")
    )
    columns = []
    for short, long in (("f", "f1"), ("p", "precision"), ("r", "recall")):
        columns += [
            F.bround(F.avg(short), 4).alias(f"macro_{long}"),
            F.bround(F.sum(F.col(short) * F.col("n")) / F.sum("n"), 4).alias(f"weighted_{long}"),
        ]
    return raw.groupBy(*run).agg(F.count("*").alias("n_classes"), *columns)


def run_results(cells: DataFrame, run: list[str] = RUN, labels: tuple[str, ...] = SIGNALLING.labels) -> DataFrame:
    """One row per run in the shape of the results store: ``metrics`` and ``per_class``."""
    scores = score_columns(F.col("tp"), F.col("pp"), F.col("n"))
    entry = F.struct(*[c.alias(k) for k, c in scores.items()], F.col("n").alias("n"))
    classes = (
        label_counts(cells, run, labels)
        .filter("n > 0")
        .groupBy(*run)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("label"), entry)))).alias("per_class"))
    )
    totals = overall(cells, run, labels)
    metrics = F.struct("f1", "precision", "recall", "exact_match", F.col("n").cast("bigint").alias("n"))
    return totals.select(*run, metrics.alias("metrics")).join(classes, run, "left")


def class_distribution(df: DataFrame, label: str = "gold", within: Sequence[str] = ()) -> DataFrame:
    """Rows per label."""
    return df.groupBy(*within, label).agg(F.count("*").alias("n"))


def prediction_health(
    df: DataFrame, run: list[str] = RUN, default: str = SIGNALLING.default
) -> DataFrame:
    """Signs that a run collapsed: share of the default label, empty and defaulted answers, number of labels in use.

    Takes (run, ``pred``, ``empty``, ``defaulted``): answers are reduced to flags before anything is shuffled. No gold
    is needed. ``defaulted`` marks answers that stand in for a failed call, see :func:`.predict.predict_batches`.
    """
    return df.groupBy(*run).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("pred") == default).alias("n_default"),
        F.count_if("empty").alias("n_empty"),
        F.count_if("defaulted").alias("n_defaulted"),
        F.count_distinct("pred").alias("n_labels"),
        ratio(F.count_if(F.col("pred") == default), F.count("*")).alias("default_share"),
    )


def misclassified(cells: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Wrong rows per run, or per run and gold label."""
    wrong = F.when(F.col("gold") != F.col("pred"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    return cells.groupBy(*by).agg(F.sum(wrong).alias("n_wrong"), F.sum("n").alias("n"))


def class_status(classes: DataFrame, near_fail_below: float) -> DataFrame:
    """PERFECT, ALL FP (predicted, never right) and NEAR FAIL (F1 under a threshold) flags per class."""
    status = (
        F.when(F.col("f1") == 1.0, "PERFECT")
        .when((F.col("tp") == 0) & (F.col("pp") > 0), "ALL FP")
        .when(F.col("f1") < near_fail_below, "NEAR FAIL")
        .otherwise("")
    )
    return classes.withColumn("status", status)


def run_invariants(cells: DataFrame, run: list[str] = RUN, labels: tuple[str, ...] = SIGNALLING.labels) -> DataFrame:
    """Checks that every scored run must pass, with the numbers behind them."""
    classes = per_class(cells, run, labels)
    sums = classes.groupBy(*run).agg(
        F.sum("n").alias("n_classes_sum"),
        F.bround(F.sum(F.col("tp")) / F.sum("n"), 4).alias("weighted_recall"),
    )
    harmonic = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return overall(cells, run, labels).join(sums, run).select(
        *run,
        "n", "n_classes_sum", (F.col("n") == F.col("n_classes_sum")).alias("support_adds_up"),
        (F.abs(F.col("weighted_recall") - F.col("f1")) <= 0.0001).alias("recall_equals_micro_f1"),
        (F.abs(F.coalesce(harmonic, F.lit(0.0)) - F.col("f1")) <= 0.0001).alias("f1_is_harmonic_mean"),
    )


def flip_table(df: DataFrame, before: str, after: str, by: list[str] = RUN) -> DataFrame:
    """How many rows of each run went from which label to which, the same ones included."""
    return df.groupBy(*by, before, after).agg(F.count("*").alias("n"))


def label_flips(df: DataFrame, before: str, after: str, by: list[str] = RUN) -> DataFrame:
    """Per run and label: rows with it before and after, and those gained and lost between two extractions of the same rows.

    Both labels stand in one row, so nothing is joined; labels x labels counts a run are all that is shuffled.
    """
    moved = F.col(before).eqNullSafe(F.col(after))
    sides = F.array(
        F.struct(F.col(before).alias("label"), F.lit(True).alias("old")), F.struct(F.col(after).alias("label"), F.lit(False).alias("old"))
    )
    rows = flip_table(df, before, after, by).select(*by, "n", moved.alias("same"), F.inline(sides))

    def total(condition) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("bigint"))

    old, same = F.col("old"), F.col("same")
    return rows.groupBy(*by, "label").agg(
        total(old).alias("n_before"), total(~old).alias("n_after"), total(~old & ~same).alias("gained"), total(old & ~same).alias("lost")
    )
