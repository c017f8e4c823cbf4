import pytest
from pyspark.errors import PySparkException

from gradeline.operators import runlogs

PROGRESS = [
    "Writing 80 records",
    "  Progress: 50/80 | written=47 skipped=3",
    "  [WARN] Failed after 2 attempts for congestion: bad value: at line 7",
    "Done: 76 examples written to out/part.jsonl (4 skipped)",
]
TRAINING = [
    "Step  10  | loss: 2.5000 | grad_norm: 1.2500 | lr: 5.000e-05 | epoch: 0.20",
    " 40%|####      | 20/50 [00:40<01:00,  2.00s/it]",
    "{'loss': 0.75, 'grad_norm': 0.5, 'learning_rate': 0.0, 'epoch': 1.5}",
    "{'train_runtime': 100.5, 'train_samples_per_second': 2.0, 'train_steps_per_second': 0.5, 'train_loss': 1.125, 'epoch': 1.5}",
    "Step 20  | loss: 1.5000 | grad_norm: 0.00 | lr: 4.000e-05 | epoch: 0.40",
]


def test_progress_lines(spark):
    lines = spark.createDataFrame([(x,) for x in PROGRESS], "value STRING")
    got = [tuple(r) for r in runlogs.parse_progress(lines).collect()]
    assert got == [
        ("progress", 50, 80, 47, 3, None, None, None, None),
        ("failed", None, None, None, None, 2, "congestion", "bad value: at line 7", None),
        ("done", None, None, 76, 4, None, None, None, "out/part.jsonl"),
    ]


def test_training_lines(spark):
    lines = spark.createDataFrame([("r", x) for x in TRAINING], "run_id STRING, value STRING")
    got = [tuple(r) for r in runlogs.parse_training(lines).collect()]
    assert got == [
        ("r", "step", 10, 2.5, 1.25, 5e-05, 0.2, None, None),
        ("r", "metrics", None, 0.75, 0.5, 0.0, 1.5, None, None),
        ("r", "totals", None, None, None, None, 1.5, 100.5, 1.125),
        ("r", "step", 20, 1.5, 0.0, 4e-05, 0.4, None, None),
    ]


def test_costs(spark):
    rows = [("small", 3105), ("large", 5984), ("small", 5915)]
    jobs = spark.createDataFrame(rows, "instance STRING, billable_seconds BIGINT")
    costs = runlogs.training_cost(jobs, {"small": "1.515", "large": "7.09"}).collect()
    assert [str(r.cost_usd) for r in costs] == ["1.31", "11.79", "2.49"]


def test_a_model_without_output_is_an_error(spark):
    listing = spark.createDataFrame([("a", "output/a/j-1/"), ("a", "output/a/j-2/")], "slug STRING, prefix STRING")
    latest = runlogs.latest_artifacts(listing)
    wanted = spark.createDataFrame([("a",)], "slug STRING")
    assert runlogs.require_artifacts(wanted, latest).first().latest == "output/a/j-2/"
    with pytest.raises(PySparkException, match="no training output found for b"):
        runlogs.require_artifacts(spark.createDataFrame([("b",)], "slug STRING"), latest).collect()
