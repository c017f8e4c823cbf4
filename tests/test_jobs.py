"""Files, batch prediction and streams."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from gradeline.operators import align, metrics, predict
from gradeline.plans import fixtures as fx
from gradeline.sources import jsonl, results_store
from gradeline.streaming import jobs


def test_positions_of_files_without_ids(spark, tmp_path):
    """File order decides, over many splits and in spite of blank lines."""
    gold = tmp_path / "gold.jsonl"
    pred = tmp_path / "pred.jsonl"
    gold.write_text("".join(json.dumps({"n": i}) + "\n" + "\n" * (i % 3) for i in range(400)))
    pred.write_text("".join(json.dumps({"n": i}) + "\n" for i in range(7, 400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        order = ["file", "block", "line"]
        read = lambda path, name: jsonl.read_lines_in_order(spark, str(path)).select(
            *[F.col(c).alias(f"{name}_{c}") for c in order], F.get_json_object("value", "$.n").alias(name)
        )
        g, p = read(gold, "g"), read(pred, "p").withColumn("run", F.lit("r"))
        assert p.rdd.getNumPartitions() > 2
        pairs = align.align_by_position(g, p, [f"g_{c}" for c in order], [f"p_{c}" for c in order], ["run"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(pairs) == 393 and all(r.g == r.p for r in pairs)


def test_bad_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"log": "a", "root_cause": ["normal"]}\n\n{"log": "b", \n')
    rows = jsonl.read_examples(spark, str(path), lenient=True).collect()
    assert [r[jsonl.CORRUPT] is not None for r in rows] == [False, True]
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        jsonl.read_examples(spark, str(path)).collect()


def test_rows_per_run(spark):
    preds = spark.createDataFrame([("a",), ("a",), ("b",)], "model STRING")
    got = {r.model: r.complete for r in jsonl.rows_per_run(preds, ["model"], F.lit(2)).collect()}
    assert got == {"a": True, "b": False}
    expected = spark.createDataFrame([("a", 2), ("c", 1)], "model STRING, n_expected BIGINT")
    got = {r.model: (r.n_rows, r.n_expected) for r in jsonl.rows_per_run(preds, ["model"], expected).collect()}
    assert got == {"a": (2, 2), "b": (1, 0), "c": (0, 1)}


def test_failed_batches_are_answered_and_marked(spark):
    def predictor(prompts):
        if "bad" in prompts:
            raise RuntimeError("service is down")
        return [f'["{p}"]' for p in prompts]

    df = spark.createDataFrame([(i, "bad" if i == 5 else "ok") for i in range(12)], "i INT, prompt STRING").coalesce(1)
    got = {r.i: (r.output, r.defaulted) for r in predict.predict_batches(df, lambda: predictor, batch_size=4).collect()}
    assert all(got[i] == ('["normal"]', True) for i in range(4, 8))
    assert all(got[i] == ('["ok"]', False) for i in (0, 1, 2, 3, 8, 9, 10, 11))


def test_a_task_without_a_single_answer_is_an_error(spark):
    def broken(prompts):
        raise TypeError("a slip in the code")

    df = spark.createDataFrame([(i, "ok") for i in range(12)], "i INT, prompt STRING").coalesce(1)
    with pytest.raises(Exception, match="every batch of the task failed"):
        predict.predict_batches(df, lambda: broken, batch_size=4).collect()


def test_a_worker_holds_few_prompts_and_answers(spark):
    """Of an Arrow batch of 40 MB, Python holds its bytes, the strings of one call and a bounded number of answers; calls stay as they were."""

    def make():
        import tracemalloc

        import pandas  # noqa: F401 - imports before memory counts

        tracemalloc.start()

        def predictor(prompts):
            now = tracemalloc.get_traced_memory()[0]
            if prompts[-1].endswith("last"):
                tracemalloc.stop()
            return [f"{len(prompts)} {now} {p[-4:]}" for p in prompts]

        return predictor

    prompt = F.concat(F.repeat(F.lit("x"), 10_000), F.when(F.col("id") == 3999, "last").otherwise(F.lpad(F.col("id").cast("string"), 4, "0")))
    df = spark.range(0, 4000, 1, 1).withColumn("prompt", prompt)
    rows = predict.predict_batches(df, make, batch_size=7).drop("prompt").orderBy("id").collect()
    calls = [r.output.split(" ") for r in rows]
    assert [c[2] for c in calls] == [f"{i:04}" for i in range(3999)] + ["last"] and not any(r.defaulted for r in rows)
    assert [int(c[0]) for c in calls] == [7] * 3997 + [3] * 3
    assert max(int(c[1]) for c in calls) < 44_000_000


def test_answers_of_any_kind_and_count(spark):
    """Nulls and answers beyond one hand-back keep their places, numbers are refused; null prompts reach the predictor as None."""

    def predictor(prompts):
        return [None if p is None else float("nan") if p == "2" else p for p in prompts]

    prompt = F.when(F.col("id") % 5 != 0, F.col("id").cast("string"))
    df = spark.range(0, 2 * predict.ANSWERS_OUT + 3, 1, 1).withColumn("prompt", prompt)
    for size in (1, 3, 5000):
        rows = predict.predict_batches(df, lambda: predictor, batch_size=size).orderBy("id").collect()
        assert [r.output for r in rows] == [None if i % 5 == 0 or i == 2 else str(i) for i in range(len(rows))]
        assert len(rows) == 2 * predict.ANSWERS_OUT + 3 and not any(r.defaulted for r in rows)
    with pytest.raises(Exception, match="[Aa]rrow"):
        predict.predict_batches(df, lambda: lambda prompts: [len(prompts)] * len(prompts), batch_size=7).collect()


def test_unpaired_predictions_are_counted_or_an_error(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "ex_id INT, gold STRING")
    preds = spark.createDataFrame([("m", 1, "a"), ("m", 3, "b"), ("n", 2, "b")], "model STRING, ex_id INT, pred STRING")
    assert {r.model: (r.n_rows, r.n_unpaired) for r in align.unpaired(gold, preds, ["model"]).collect()} == {"m": (2, 1), "n": (1, 0)}
    assert align.align_by_id(gold, preds).count() == 2
    with pytest.raises(Exception, match="no gold row for 3"):
        align.align_by_id(gold, preds, strict=True).collect()


def test_scores_grow_with_arriving_files(spark, sf_dir, tmp_path):
    arriving, cells, state = (str(tmp_path / n) for n in ("arriving", "cells", "state"))
    kept = str(tmp_path / "store")
    preds = fx.predictions(spark, sf_dir).select("model", "strategy", "ex_id", "output")
    gold = fx.gold_labels(spark, sf_dir)
    schema = "model STRING, strategy STRING, ex_id BIGINT, output STRING"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(arriving)
        jobs.score_increments(stream, gold, cells, state, kept, available_now=True).awaitTermination()
        stored = {(r.model, r.strategy): (r.metrics.n, r.metrics.f1) for r in results_store.read_store(spark, kept).collect()}
        assert stored == {(r.model, r.strategy): (r.metrics.n, r.metrics.f1) for r in jobs.scored_runs(spark, cells).collect()}
        return stored

    preds.filter("ex_id < 100").repartition(3).write.parquet(arriving)
    first = run()
    preds.filter("ex_id >= 100").repartition(3).write.mode("append").parquet(arriving)
    second = run()
    assert first["m0", "slm"][0] == 100 and second["m0", "slm"] == (200, 0.955)
    assert second["m2", "five_shot_cot"] == (195, 0.6974)
    assert run() == second
    preds.filter("ex_id < 2").withColumn("ex_id", F.col("ex_id") + 9000).write.mode("append").parquet(arriving)
    assert run() == second
    assert jobs.total_cells(spark, cells).filter("gold IS NULL").agg(F.sum("n")).first()[0] == 8
    order = [r.store_ord for r in results_store.read_store(spark, kept).collect()]
    assert len(set(order)) == len(order) == 6
    held = spark.read.parquet(cells).groupBy("model", "strategy").agg(F.countDistinct("batch").alias("n")).collect()
    assert len(held) == 6 and all(r.n <= 2 for r in held)


def test_a_batch_touches_only_its_runs_and_may_be_repeated(spark, tmp_path):
    arriving, cells, kept = (str(tmp_path / n) for n in ("arriving", "cells", "store"))
    schema = "model STRING, strategy STRING, ex_id BIGINT, output STRING"
    gold = spark.createDataFrame([(k, "congestion") for k in range(8)], "ex_id BIGINT, gold STRING")

    def arrive(rows, state):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(schema).parquet(arriving)
        jobs.score_increments(stream, gold, cells, str(tmp_path / state), kept, available_now=True).awaitTermination()

    arrive([("a", "s", 0, '["congestion"]'), ("b", "s", 0, '["normal"]')], "state")
    untouched = {p.name for p in (tmp_path / "cells").glob("model=b/strategy=s/*.parquet")}
    shutil.copytree(tmp_path / "state", tmp_path / "before")
    arrive([("a", "s", 1, '["normal"]')], "state")
    first = sorted(map(str, jobs.total_cells(spark, cells).collect()))
    assert {p.name for p in (tmp_path / "cells").glob("model=b/strategy=s/*.parquet")} == untouched
    # the second batch again, from the checkpoint before it, as after a failure that came late
    stream = spark.readStream.schema(schema).parquet(arriving)
    jobs.score_increments(stream, gold, cells, str(tmp_path / "before"), kept, available_now=True).awaitTermination()
    assert sorted(map(str, jobs.total_cells(spark, cells).collect())) == first
    assert {(r.model, r.metrics.n) for r in results_store.read_store(spark, kept).collect()} == {("a", 2), ("b", 1)}


def test_losses_of_growing_logs(spark, tmp_path):
    """In order, late, logged again, without a loss, and a batch that is repeated: as if the log were read whole."""
    arriving, kept = (str(tmp_path / n) for n in ("arriving", "losses"))

    def line(step, loss):
        return f"Step {step} | loss: {loss} | epoch: 0.1"

    def follow(state="state"):
        stream = spark.readStream.schema("run_id STRING, value STRING").parquet(arriving)
        jobs.follow_losses(stream, kept, str(tmp_path / state), available_now=True).awaitTermination()
        return {(r.run_id, r.step): (r.loss, r.previous_loss) for r in jobs.loss_changes(spark, kept).collect()}

    def arrive(*rows):
        spark.createDataFrame([(r, line(*x)) for r, *x in rows], "run_id STRING, value STRING").coalesce(1).write.mode("append").parquet(arriving)

    whole = {}

    def want():
        runs = {}
        for (run, step), loss in sorted(whole.items()):
            runs.setdefault(run, []).append((step, loss))
        return {(run, s): (x, before) for run, steps in runs.items() for (s, x), (_, before) in zip(steps, [(None, None), *steps])}

    batches = [
        [("a", 10, 1.0), ("a", 30, 0.5), ("b", 10, 3.0)],
        [("a", 40, 0.25), ("a", 50, 0.125), ("c", 5, 9.0)],
        [("a", 20, 0.75), ("b", 20, 2.0), ("a", 60, 0.0625)],
        [("a", 40, 0.3), ("b", 5, 4.0), ("c", 6, 8.0)],
    ]
    for number, batch in enumerate(batches):
        shutil.copytree(tmp_path / "state", tmp_path / f"before{number}") if number else None
        arrive(*batch)
        whole |= {(r, s): x for r, s, x in batch}
        assert follow() == want()
        if number:  # the batch once more, from the checkpoint before it
            assert follow(f"before{number}") == want()
    arrive()
    assert follow() == want()
    states = spark.read.parquet(f"{kept}/states").groupBy("run_id").count().collect()
    assert {r.run_id for r in states} == {"a", "b", "c"} and all(r["count"] <= 2 for r in states)


def test_windows_close_with_the_watermark(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:20:00", "b")]
    events = spark.createDataFrame(rows, "ts STRING, kind STRING").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    jobs.append_to(jobs.label_windows(stream, "kind"), out, state, available_now=True).awaitTermination()
    assert [(r.kind, r.n) for r in spark.read.parquet(out).collect()] == [("a", 2)]


def test_collapsed_run_is_visible(spark):
    rows = [("m", "s", "normal", "")] * 9 + [("m", "s", "congestion", "x")]
    df = spark.createDataFrame(rows, "model STRING, strategy STRING, pred STRING, output STRING")
    row = metrics.prediction_health(df.selectExpr("*", "output = '' AS empty", "output = 'x' AS defaulted")).first()
    assert (row.n_default, row.n_empty, row.n_defaulted, row.n_labels, row.default_share) == (9, 9, 1, 2, 0.9)
