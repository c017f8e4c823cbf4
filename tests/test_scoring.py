import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradeline.operators import align, metrics

RUN = ["model", "strategy"]


@pytest.fixture(scope="module")
def cells(spark):
    pairs = [("normal", "normal")] * 3 + [("normal", "congestion")] * 2 + [("radio_failure", "normal")]
    df = spark.createDataFrame([("m", "s", g, p) for g, p in pairs], "model STRING, strategy STRING, gold STRING, pred STRING")
    return metrics.confusion_matrix(df)


def test_per_class(cells):
    rows = {r.label: (r.tp, r.pp, r.n, r.precision, r.recall, r.f1) for r in metrics.per_class(cells).collect()}
    assert rows == {
        "normal": (3, 4, 5, 0.75, 0.6, 0.6667),
        "radio_failure": (0, 0, 1, 0.0, 0.0, 0.0),  # in gold, never predicted; "congestion" has no gold rows
    }


def test_overall(cells):
    row = metrics.overall(cells).first()
    assert (row.f1, row.precision, row.recall, row.exact_match, row.n_correct, row.n) == (0.5, 0.5, 0.5, 0.5, 3, 6)


def test_micro_scores_count_only_the_label_set(cells):
    row = metrics.overall(cells, labels=("normal",)).first()
    assert (row.precision, row.recall, row.exact_match) == (0.75, 0.6, 0.5)


def test_averages_and_status(cells):
    classes = metrics.per_class(cells)
    row = metrics.averages(classes).first()
    assert (row.macro_f1, row.weighted_recall) == (0.3333, 0.5)
    status = {r.label: r.status for r in metrics.class_status(classes, 0.7).collect()}
    assert status == {"normal": "NEAR FAIL", "radio_failure": "NEAR FAIL"}


def test_run_results(cells):
    row = metrics.run_results(cells).first()
    assert row.metrics.n == 6 and set(row.per_class) == {"normal", "radio_failure"}
    assert row.per_class["normal"].asDict() == {"f1": 0.6667, "precision": 0.75, "recall": 0.6, "n": 5}


def test_position_pairs_skip_the_first_gold_rows(spark):
    gold = spark.range(992).select(F.col("id").alias("g"))
    preds = spark.range(987).select(F.lit("m").alias("model"), F.col("id").alias("p"))
    got = align.align_by_position(gold, preds, ["g"], ["p"], ["model"])
    assert got.count() == 987 and got.filter("g <> p + 5").count() == 0


def test_more_predictions_than_gold_rows_is_an_error(spark):
    gold = spark.range(10).select(F.col("id").alias("g"))
    preds = spark.range(11).select(F.lit("m").alias("model"), F.col("id").alias("p"))
    with pytest.raises(PySparkException, match="more predictions than gold rows: m"):
        align.align_by_position(gold, preds, ["g"], ["p"], ["model"]).collect()


def test_shots_are_not_evaluated(spark):
    shots, rest = align.split_shots(spark.range(20).withColumnRenamed("id", "ex_id"), 5, ["ex_id"])
    assert sorted(r.ex_id for r in shots.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.ex_id for r in rest.collect()) == list(range(5, 20))


def test_the_planner_picks_the_join(spark):
    gold = spark.range(1000).select(F.col("id").alias("ex_id"), (F.col("id") % 8).alias("gold"))
    preds = spark.range(3000).select((F.col("id") % 1000).alias("ex_id"), (F.col("id") % 3).alias("model"))
    joined = align.align_by_id(gold, preds)
    assert "Hint" not in joined._jdf.queryExecution().analyzed().toString() and joined.count() == 3000
