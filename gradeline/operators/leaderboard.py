"""The results store as a table, and rankings and comparisons over it.

These tables hold one row per run, or per run and label: they grow with the number
of scored runs, not with the data those runs were scored on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent

RUN = ["model", "strategy"]


def latest_rows(runs: DataFrame, run: list[str] = RUN, order: str = "store_ord") -> DataFrame:
    """One row per run: the last one."""
    whole = F.struct(*runs.columns)
    return runs.groupBy(*run).agg(F.max_by(whole, order).alias("_row")).select("_row.*")


def upsert_runs(old: DataFrame, new: DataFrame, run: list[str] = RUN, order: str = "store_ord") -> DataFrame:
    """Replace runs with equal keys; new rows go to the end of the store in their own order, the last one of each run only."""
    last = old.agg(F.coalesce(F.max(order), F.lit(-1))).scalar()
    appended = latest_rows(new, run, order).withColumn(order, last + 1 + F.col(order))
    return old.join(new.select(*run), run, "left_anti").unionByName(appended)


def rank_runs(runs: DataFrame, score: str = "f1", order: str = "store_ord") -> DataFrame:
    """Number the runs from 1 by falling score; equal scores keep store order."""
    by_score = Window.orderBy(F.desc(score), F.asc(order))
    ranked = runs.withColumn("rank", F.row_number().over(by_score))
    return ranked.withColumn("is_best", F.col("rank") == 1)


def best_per(runs: DataFrame, by: str, score: str = "f1", tie_break: Sequence[str] = ("strategy",)) -> DataFrame:
    """The best-scored row of every ``by``; pre-aggregated before the shuffle."""
    rest = [c for c in runs.columns if c not in (by, score, *tie_break)]
    candidate = F.struct((-F.col(score)).alias("_loss"), *tie_break, *rest)
    best = runs.groupBy(by).agg(F.min(candidate).alias("_best"))
    return best.select(
        by, (-F.col("_best._loss")).alias(score), *[F.col(f"_best.{c}").alias(c) for c in (*tie_break, *rest)]
    )


def lookup(key: Column, names: dict[str, str], fallback: Column | None = None) -> Column:
    """Display name of a key from a small dictionary; the key itself when it is not listed."""
    if not names:
        return key if fallback is None else fallback
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), key if fallback is None else fallback)


def summary_table(
    runs: DataFrame, models: dict[str, str], strategies: dict[str, str], kinds: dict[str, str]
) -> DataFrame:
    """The ranked report table with display names and percentages."""
    ranked = rank_runs(runs)
    return ranked.select(
        "rank", "is_best",
        lookup(F.col("model"), models).alias("model_name"),
        lookup(F.col("model"), kinds, F.lit("")).alias("kind"),
        lookup(F.col("strategy"), strategies).alias("strategy_name"),
        *[percent(F.col(c)).alias(f"{c}_pct") for c in ("f1", "precision", "recall", "exact_match")],
        "n",
    )


def with_display_names(runs: DataFrame, names: DataFrame, key: str, out: str, fallback: Column | None = None) -> DataFrame:
    """Look names up in a table with columns (key, ``name``); its size decides how the join runs."""
    joined = runs.join(names.select(key, F.col("name").alias(out)), key, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.col(key) if fallback is None else fallback))


def label_grid(
    classes: DataFrame, labels: tuple[str, ...], run: list[str] = RUN, keep_missing: bool = True, runs: DataFrame | None = None
) -> DataFrame:
    """One row per run and label in label order; labels a run lacks have n = 0, or are left out.

    ``runs`` lists the runs to show, also those without a single class row; by default those that have one.
    """
    if not keep_missing:
        place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
        return classes.withColumn("label_ord", (place - 1).cast("int")).filter("label_ord >= 0")
    wanted = F.array(*[F.lit(x) for x in labels])
    values = [c for c in classes.columns if c not in (*run, "label")]
    entries = F.map_from_entries(F.collect_list(F.struct("label", F.struct(*values))))
    by_run = classes.filter(F.col("label").isin(*labels)).groupBy(*run).agg(entries.alias("_classes"))
    if runs is not None:
        by_run = runs.select(*run).distinct().join(by_run, run, "left")
    grid = by_run.select(*run, "_classes", F.posexplode(wanted).alias("label_ord", "label"))
    cell = F.try_element_at("_classes", F.col("label"))
    return grid.select(
        *run, "label_ord", "label",
        *[cell[c].alias(c) for c in values if c != "n"], F.coalesce(cell["n"], F.lit(0)).alias("n"),
    )


def select_runs(runs: DataFrame, keys: DataFrame, run: list[str] = RUN) -> DataFrame:
    """Only the runs whose keys are listed."""
    return runs.join(keys.select(*run), run, "left_semi")


def drop_runs(runs: DataFrame, keys: DataFrame, run: list[str] = RUN) -> DataFrame:
    """The keys of all runs that are not listed."""
    return runs.select(*run).exceptAll(keys.select(*run))


def baseline_delta(
    runs: DataFrame, baseline: Column, by: list[str], values: list[str], keep: list[str]
) -> DataFrame:
    """Every row, the baseline included, against the baseline row of its group: baseline value and change in points.

    Both are null in a group without a baseline.
    """
    base = runs.filter(baseline).select(*by, *[F.col(v).alias(f"baseline_{v}") for v in values])
    joined = runs.join(base, by, "left")
    points = [F.round((F.col(v) - F.col(f"baseline_{v}")) * 100, 2).alias(f"{v}_change") for v in values]
    return joined.select(*by, *keep, *[c for v in values for c in (v, f"baseline_{v}")], *points)


def with_family(runs: DataFrame, families: DataFrame, model: str = "model", family: str = "family", joint: str = "-") -> DataFrame:
    """Add the longest name in ``families`` that the model's name is, or begins with up to a joint; null if there is none.

    The beginnings of each distinct model name are looked up by equality, so names are never compared pair by pair.
    """
    segments = F.split(F.col(model), F.lit(joint).cast("string"), -1)
    beginnings = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, 1, k), joint))
    asked = runs.select(model).distinct().select(F.col(model).alias("_model"), F.explode(beginnings).alias("_name"))
    known = families.select(F.col(family).alias("_name")).distinct()
    longest = asked.join(known, "_name").groupBy("_model").agg(F.max_by("_name", F.char_length("_name")).alias(family))
    return runs.join(longest, F.col(model) == F.col("_model"), "left").drop("_model")


def family_delta(runs: DataFrame, families: DataFrame, by: list[str], values: list[str], model: str = "model", joint: str = "-") -> DataFrame:
    """Every run against the run of its family's own name, in points; the columns of :func:`baseline_delta`, with the family.

    ``by`` names what must be equal besides the family, such as the strategy. Runs without a family, or whose family
    has no run of its own, have null changes.
    """
    named = with_family(runs, families, model, joint=joint)
    keep = [c for c in [model, "store_ord"] if c in runs.columns]
    return baseline_delta(named, F.col(model) == F.col("family"), ["family", *by], values, keep)


def strategy_pivot(runs: DataFrame, strategies: list[str], score: str = "f1") -> DataFrame:
    """Scores of every model by strategy, with the gain of few-shot examples and of reasoning in points."""
    wide = runs.groupBy("model").pivot("strategy", strategies).agg(F.first(score))

    def gain(better: str, base: str) -> Column:
        if better not in strategies or base not in strategies:
            return F.lit(None).cast("double")
        return F.round((F.col(better) - F.col(base)) * 100, 2)

    return wide.withColumns(
        {"few_shot_gain": gain("five_shot", "zero_shot"), "cot_gain": gain("five_shot_cot", "five_shot")}
    )


def scenario_matrix(classes: DataFrame, runs: list[tuple[str, str]], score: str = "f1") -> DataFrame:
    """Labels down, runs across: score and status of every cell, and the number of runs that have no error in the label.

    ``classes`` carries ``status``, see :func:`.metrics.class_status`. :func:`perfect_classes` counts by run.
    """
    names = [f"{model}/{strategy}" for model, strategy in runs]
    keyed = classes.withColumn("_run", F.concat_ws("/", "model", "strategy"))
    wide = keyed.groupBy("label").pivot("_run", names).agg(F.first(score).alias(score), F.first("status").alias("status"))
    perfect = [F.coalesce(F.col(f"`{n}_status`") == "PERFECT", F.lit(False)).cast("bigint") for n in names]
    return wide.withColumn("n_perfect", sum(perfect[1:], perfect[0]))


def perfect_classes(classes: DataFrame, run: list[str] = RUN) -> DataFrame:
    """Labels without a single error, per run."""
    return classes.groupBy(*run).agg(
        F.count_if(F.col("f1") == 1.0).alias("n_perfect"), F.count("*").alias("n_classes")
    )
