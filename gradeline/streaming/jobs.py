"""Structured Streaming jobs on the same column expressions as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import extract_labels
from ..functions.vocab import SIGNALLING, Vocabulary
from ..operators.metrics import RUN, confusion_matrix, run_results
from ..operators.runlogs import parse_training
from ..operators.sequence import previous_values
from ..sources import results_store
from ..sources.workspace import exists, scratch, stage


def follow_training(
    lines: DataFrame, store: str, checkpoint: str, run: str = "run_id", available_now: bool = False
) -> StreamingQuery:
    """Keep the latest metrics of every training run in a table while its log grows.

    ``lines`` is a stream of (run, ``value``). The state is one row per run, whatever
    the length of its log. A batch rewrites only the folders of the runs it saw, so
    repeating it after a failure changes nothing.
    """
    steps = parse_training(lines).filter("kind = 'step'")
    latest = steps.groupBy(run).agg(
        F.max("step").alias("last_step"),
        F.max_by("loss", "step").alias("last_loss"),
        F.max_by("epoch", "step").alias("last_epoch"),
        F.count("*").alias("n_points"),
    )

    def publish(batch: DataFrame, _: int) -> None:
        writer = batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(run).parquet(store)

    writer = latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return _start(writer, available_now)


def follow_losses(
    lines: DataFrame, store: str, checkpoint: str, run: str = "run_id", available_now: bool = False
) -> StreamingQuery:
    """Keep the change of the loss from step to step of every training run in a table while its log grows.

    ``lines`` is a stream of (run, ``value``). The state is the last step and loss of every run, as of its last two batches. A batch
    links its steps to the last one before them, so it reads the states of its runs and not their logs. Steps are chained
    in ranges, so a run with most lines of a batch is split. Where lines come late, at or before the last step, the steps held of that run are
    chained anew with them, and the steps whose neighbour they change are written again. A step that is logged again has
    the loss of the later batch, and in one batch the lowest. A repeated batch starts from the state before it and replaces what it wrote.
    :func:`loss_changes` reads the table; ``store`` and ``checkpoint`` belong together.
    """
    points = parse_training(lines).filter("kind = 'step'").select(run, "step", "loss")
    key, rows, states = [run, "step"], f"{store}/changes", f"{store}/states"

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        typed = {f.name: f.dataType.simpleString() for f in batch.schema}
        with scratch():
            new = stage(batch.groupBy(*key).agg(F.min("loss").alias("loss")), "points")
            firsts = new.groupBy(run).agg(F.min("step").alias("first_step"))
            chain = new.select(*key, "loss", F.lit("new").alias("origin"), F.lit(None).cast("double").alias("linked"))
            held = None
            if exists(spark, states):
                earlier = spark.read.schema(f"last_loss DOUBLE, batch BIGINT, last_step BIGINT, `{run}` {typed[run]}").parquet(states)
                earlier = earlier.filter(F.col("batch") < batch_id).join(firsts, run)
                held = stage(earlier.groupBy(run, "first_step").agg(
                    F.max_by(F.struct("last_step", "last_loss", "batch"), "batch").alias("last")
                ).select(run, "last.*", (F.col("first_step") <= F.col("last.last_step")).alias("late")), "held")
                ends = held.filter("NOT late").select(
                    run, F.col("last_step").alias("step"), F.col("last_loss").alias("loss"), F.lit("end").alias("origin"),
                    F.lit(None).cast("double").alias("linked"),
                )
                late = held.filter("late").select(run)
                told = _told(spark, rows, run, typed[run], batch_id).join(late, run, "left_semi").join(new, key, "left_anti")
                chain = chain.unionByName(ends).unionByName(
                    told.select(*key, "loss", F.lit("told").alias("origin"), F.col("previous_loss").alias("linked"))
                )
            chained = stage(previous_values(stage(chain, "chain"), {"previous_loss": "loss"}, ["step"], [run]), "chained")
            fresh = (F.col("origin") == "new") | ((F.col("origin") == "told") & ~F.col("linked").eqNullSafe(F.col("previous_loss")))
            mark = F.lit(batch_id).cast("bigint").alias("batch")
            _replace(chained.filter(fresh).select(*key, "loss", "previous_loss", mark), rows, ["batch"])
            last = chained.groupBy(run).agg(F.max("step").alias("last_step"), F.max_by("loss", "step").alias("last_loss"))
            last = last.select("last_loss", mark, "last_step", run)
            if held is not None:
                last = last.unionByName(held.select("last_loss", "batch", "last_step", run))
            _replace(last, states, [run])

    writer = points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    return _start(writer, available_now)


def _replace(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the folders of the values of ``by`` that the rows have."""
    writer = rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def _told(spark: SparkSession, path: str, run: str, kind: str, before: int | None = None) -> DataFrame:
    """The last word on every step."""
    rows = spark.read.schema(f"`{run}` {kind}, step BIGINT, loss DOUBLE, previous_loss DOUBLE, batch BIGINT").parquet(path)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.groupBy(run, "step").agg(F.max_by(F.struct("loss", "previous_loss"), "batch").alias("told")).select(run, "step", "told.*")


def loss_changes(spark: SparkSession, store: str, run: str = "run_id", kind: str = "string") -> DataFrame:
    """(run, step, loss, previous_loss, loss_change) of all steps that :func:`follow_losses` has seen."""
    told = _told(spark, f"{store}/changes", run, kind)
    return told.withColumn("loss_change", F.round(F.col("loss") - F.col("previous_loss"), 6))


def score_increments(
    predictions: DataFrame,
    gold: DataFrame,
    cells: str,
    checkpoint: str,
    store: str,
    vocab: Vocabulary = SIGNALLING,
    available_now: bool = False,
) -> StreamingQuery:
    """Score arriving predictions (run, ex_id, output) and keep the results of all runs in the store.

    Extraction is stateless. The confusion counts of every run lie in a folder of its own, labels x labels rows each for its last two
    batches. A batch reads and rewrites the folders of the runs it saw only, scores those runs and puts them into the store, each at a place
    of its own in the order of their names. A repeated batch starts from the counts before it and replaces what it wrote. Predictions
    without a gold row are counted with a null gold label and take no part in the scores. ``cells``, ``checkpoint`` and ``store`` belong
    together: start all anew, or none.
    """
    extracted = extract_labels(predictions, "output", vocab, "codes")
    labelled = extracted.select(*RUN, "ex_id", F.element_at("codes", 1).alias("pred")).join(gold, "ex_id", "left")

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch():
            new = stage(confusion_matrix(batch), "increment")
            whole = new.select(*RUN, "gold", "pred", "n").withColumn("batch", F.lit(batch_id).cast("bigint"))
            held = None
            if exists(spark, cells):
                earlier = _read_cells(spark, cells).filter(F.col("batch") < batch_id)
                held = stage(_last_counts(earlier.join(new.select(*RUN).distinct(), RUN, "left_semi")), "held")
                sums = whole.unionByName(held).groupBy(*RUN, "gold", "pred").agg(F.sum("n").alias("n"))
                whole = stage(sums.withColumn("batch", F.lit(batch_id).cast("bigint")), "counts")
            _replace(whole if held is None else whole.unionByName(held), cells, RUN)
            scores = run_results(whole.drop("batch").filter("gold IS NOT NULL"), labels=vocab.labels)
            place = F.row_number().over(Window.orderBy(*RUN)).cast("bigint") - 1  # one row per run of the batch
            results_store.upsert_store(spark, stage(scores.withColumn(results_store.STORE_ORDER, place), "scores"), store)

    writer = labelled.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    return _start(writer, available_now)


CELLS = "gold STRING, pred STRING, n BIGINT, batch BIGINT, model STRING, strategy STRING"


def _read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CELLS).parquet(path)


def _last_counts(cells: DataFrame) -> DataFrame:
    """The counts that the last batch of each run left."""
    last = cells.groupBy(*RUN).agg(F.max("batch").alias("batch"))
    return cells.join(last, [*RUN, "batch"], "left_semi")


def total_cells(spark: SparkSession, cells: str) -> DataFrame:
    """The confusion matrix over all batches so far; ``gold`` is null for predictions without a gold row."""
    return _last_counts(_read_cells(spark, cells)).select(*RUN, "gold", "pred", "n")


def scored_runs(spark: SparkSession, cells: str, vocab: Vocabulary = SIGNALLING) -> DataFrame:
    """Results of all runs seen so far, ready for the results store."""
    return run_results(total_cells(spark, cells).filter("gold IS NOT NULL"), labels=vocab.labels)


def label_windows(
    events: DataFrame, label: str, time: str = "ts", width: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Labels per event-time window; windows close once the watermark has passed their end."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    counts = stamped.groupBy(F.window(time, width), label).agg(F.count("*").alias("n"))
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), label, "n"
    )


def collapse_windows(
    events: DataFrame,
    label: str,
    watched: str,
    run: str,
    time: str = "ts",
    width: str = "1 hour",
    lateness: str = "10 minutes",
    limit: float = 0.9,
    least: int = 1,
) -> DataFrame:
    """Per run and closed window: rows, rows with the watched label, its share, and whether the run has collapsed there.

    A run has collapsed in a window if at least ``limit`` of its rows, and of at least ``least`` rows, have the label. Two stateful
    steps follow each other on one watermark: rows are counted by label first, so that however hot a run is, the second step gets as
    many rows of it as there are labels. Rows without a label count as rows of a label of their own.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    counts = stamped.groupBy(F.window(time, width), run, label).agg(F.count("*").alias("k"))
    mine = F.coalesce(F.col(label) == watched, F.lit(False))
    shares = counts.groupBy(F.window(F.window_time("window"), width), run).agg(
        F.sum("k").alias("n"), F.sum(F.when(mine, F.col("k")).otherwise(0)).alias("n_watched")
    )
    share = F.col("n_watched") / F.col("n")
    return shares.withColumns({"share": share, "collapsed": (share >= limit) & (F.col("n") >= least)})


def collapse_alarm(windows: DataFrame, run: str, period: str = "1 day", least_windows: int = 1) -> DataFrame:
    """Runs that have collapsed in at least ``least_windows`` of the windows of a closed period; a further step on the same watermark."""
    periods = windows.groupBy(F.window(F.window_time("window"), period), run).agg(
        F.count("*").alias("n_windows"), F.count_if("collapsed").alias("n_collapsed"), F.sum("n").alias("n"), F.max("share").alias("top_share")
    )
    return periods.filter(F.col("n_collapsed") >= least_windows).select(
        run, F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), "n_windows", "n_collapsed", "n",
        F.bround("top_share", 4).alias("top_share"),
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to a parquet table."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _start(writer.outputMode("append"), available_now)


def _start(writer, available_now: bool) -> StreamingQuery:
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
