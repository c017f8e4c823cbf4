"""Analytics over progress and training logs, artifact listings and job costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import stage
from .sequence import previous_values, running_totals

# The shapes of the log lines.
PROGRESS_LINE = r"Progress: (\d+)/(\d+) \| written=(\d+) skipped=(\d+)"
FAILED_LINE = r"\[WARN\] Failed after (\d+) attempts for ([^:]+): (.*)"
DONE_LINE = r"Done: (\d+) examples written to (.*) \((\d+) skipped\)"
TRAINING_LINE = r"Step\s+\d+\s*\|\s*loss|^\{'(loss|train_runtime)':"
METRICS_LINE, TOTALS_LINE = "{'loss':", "{'train_runtime':"


def _group(line: Column, pattern: str, index: int, kind: str = "string") -> Column:
    return F.nullif(F.regexp_extract(line, pattern, index), F.lit("")).try_cast(kind)


def parse_progress(lines: DataFrame, line: str = "value") -> DataFrame:
    """Type the lines of a generation log; lines of other shapes are dropped."""
    text = F.col(line)
    kind = (
        F.when(F.contains(text, F.lit("[WARN] Failed after ")), "failed")
        .when(F.contains(text, F.lit("Progress: ")), "progress")
        .otherwise("done")
    )
    shapes = "|".join((PROGRESS_LINE, FAILED_LINE, DONE_LINE))
    typed = lines.filter(text.rlike(shapes)).withColumn("kind", kind)

    def number(progress: int | None, done: int | None) -> Column:
        column = F.lit(None).cast("bigint")
        if done:
            column = F.when(F.col("kind") == "done", _group(text, DONE_LINE, done, "bigint"))
        if progress:
            column = F.when(F.col("kind") == "progress", _group(text, PROGRESS_LINE, progress, "bigint")).otherwise(column)
        return column

    def failed(index: int, kind: str = "string") -> Column:
        return F.when(F.col("kind") == "failed", _group(text, FAILED_LINE, index, kind))

    return typed.select(
        *[c for c in lines.columns if c != line], "kind",
        number(1, None).alias("position"), number(2, None).alias("total"),
        number(3, 1).alias("written"), number(4, 3).alias("skipped"),
        failed(1, "int").alias("attempts"), failed(2).alias("label"), failed(3).alias("reason"),
        F.when(F.col("kind") == "done", _group(text, DONE_LINE, 2)).alias("target"),
    )


def parse_training(lines: DataFrame, line: str = "value") -> DataFrame:
    """Type the metric lines of a training log; other lines are dropped.

    ``step`` lines carry a step number. The trainer's own lines are dictionary
    literals: ``metrics`` without a step, and one ``totals`` line at the end.
    """
    text = F.col(line)
    kind = F.when(text.startswith(METRICS_LINE), "metrics").when(text.startswith(TOTALS_LINE), "totals").otherwise("step")
    typed = lines.filter(text.rlike(TRAINING_LINE)).withColumn("kind", kind)
    # Both shapes become "name:value,name:value" without a pattern: one pass over the line, one split.
    flat = F.translate(text, "|{}'\" \t", ",")
    pairs = typed.withColumn("_parts", F.split(flat, ","))

    def part(name: str) -> Column:
        first = F.try_element_at(F.filter("_parts", lambda p: p.startswith(name)), F.lit(1))
        return F.substring(first, len(name) + 1, 64)

    def value(*names: str, kind: str = "double") -> Column:
        return F.coalesce(*map(part, names)).try_cast(kind)

    return pairs.select(
        *[c for c in lines.columns if c != line], "kind",
        value("Step", kind="bigint").alias("step"), value("loss:").alias("loss"), value("grad_norm:").alias("grad_norm"),
        value("lr:", "learning_rate:").alias("lr"), value("epoch:").alias("epoch"),
        value("train_runtime:").alias("runtime_s"), value("train_loss:").alias("mean_loss"),
    )


def training_summary(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """First, last, lowest and mean loss of every run."""
    return steps.filter("kind = 'step'").groupBy(run).agg(
        F.count("*").alias("n_points"),
        F.min_by("loss", "step").alias("first_loss"),
        F.max_by("loss", "step").alias("last_loss"),
        F.min("loss").alias("min_loss"),
        F.round(F.avg("loss"), 4).alias("mean_loss"),
        F.max("step").alias("last_step"),
        F.max_by("epoch", "step").alias("last_epoch"),
    )


def loss_progression(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """Change of the loss from one logged step of a run to the next."""
    points = stage(steps.filter("kind = 'step'").select(run, "step", "loss"), "points")
    chained = previous_values(points, {"previous_loss": "loss"}, ["step"], [run])
    return chained.withColumn("loss_change", F.round(F.col("loss") - F.col("previous_loss"), 6))


def progress_counters(parsed: DataFrame, order_by: list[str], within: list[str], every: int = 50) -> DataFrame:
    """Records written and skipped so far, after every ``every`` records of a sequence."""
    flags = parsed.select(
        *within, *order_by,
        F.col("reason").isNull().cast("bigint").alias("_written"),
        F.col("reason").isNotNull().cast("bigint").alias("_skipped"),
    )
    # Finding the ranges reads the rows one more time: flags are cheap to read again, records are not.
    totals = running_totals(stage(flags, "flags"), {"written": "_written", "skipped": "_skipped"}, order_by, within)
    reported = totals.filter((F.col("ord") + 1) % every == 0)
    return reported.select(*within, (F.col("ord") + 1).alias("position"), "written", "skipped")


def latest_artifacts(
    listing: DataFrame, by: str = "slug", prefix: str = "prefix", usable: Column | None = None
) -> DataFrame:
    """The last prefix per model; names end in a time stamp, so the greatest name is the newest."""
    candidates = listing if usable is None else listing.filter(usable)
    return candidates.groupBy(by).agg(F.max(prefix).alias("latest"), F.count("*").alias("n_candidates"))


def require_artifacts(wanted: DataFrame, latest: DataFrame, by: str = "slug") -> DataFrame:
    """The newest artifact of every wanted model; a model without one is an error."""
    joined = wanted.join(latest, by, "left")
    message = F.concat(F.lit("no training output found for "), F.col(by))
    return joined.withColumn("latest", F.coalesce(F.col("latest"), F.raise_error(message).cast("string")))


def training_cost(jobs: DataFrame, hourly_usd: dict[str, str]) -> DataFrame:
    """Cost of every job in whole cents: billable seconds at the hourly price of its instance type."""
    price = F.create_map(*[x for k, v in hourly_usd.items() for x in (F.lit(k), F.lit(v).cast("decimal(12,4)"))])
    hourly = F.try_element_at(price, F.col("instance"))
    cost = F.col("billable_seconds").cast("decimal(18,0)") * hourly / F.lit(3600).cast("decimal(4,0)")
    return jobs.withColumn("cost_usd", F.round(cost, 2).cast("decimal(18,2)"))


def steps_per_epoch(n_examples: Column, batch_size: int, accumulation: int) -> Column:
    """Optimiser steps that see every example once."""
    return F.ceil(n_examples / (batch_size * accumulation))


def cost_per_thousand(cost: Column, n_predictions: Column) -> Column:
    """Cost of a thousand predictions, with four digits."""
    return F.round(cost * 1000 / n_predictions.cast("decimal(18,0)"), 4).cast("decimal(18,4)")
