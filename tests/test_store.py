import pytest
from pyspark.sql import functions as F

from gradeline.operators import leaderboard, metrics
from gradeline.sources import results_store as store

LABELS = ("normal", "congestion")


def results(spark, scores, first=0):
    rows = [
        (m, s, (f, f, f, f, 10), {"normal": (f, f, f, 6), "congestion": (1.0, 1.0, 1.0, 4)}, first + i)
        for i, (m, s, f) in enumerate(scores)
    ]
    return spark.createDataFrame(rows, f"{store.RESULTS}, {store.STORE_ORDER} BIGINT")


def listed(df):
    return [(r.model, r.strategy, r.f1) for r in store.overall_rows(df).orderBy(store.STORE_ORDER).collect()]


def test_upsert_moves_a_run_to_the_end_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(results(spark, [("a", "s", 0.5), ("b", "s", 0.6), ("a", "t", 0.7)]), path)
    again = results(spark, [("a", "s", 0.9)])
    store.upsert_store(spark, again, path)
    want = [("b", "s", 0.6), ("a", "t", 0.7), ("a", "s", 0.9)]
    assert listed(store.read_store(spark, path)) == want
    store.upsert_store(spark, again, path)
    assert listed(store.read_store(spark, path)) == want


def test_table_upsert_equals_store_upsert(spark):
    old = results(spark, [("a", "s", 0.5), ("b", "s", 0.6)])
    assert listed(leaderboard.upsert_runs(old, results(spark, [("a", "s", 0.1), ("c", "s", 0.2)]))) == [
        ("b", "s", 0.6), ("a", "s", 0.1), ("c", "s", 0.2),
    ]


def test_json_document_round_trip(spark, tmp_path):
    path = str(tmp_path / "doc")
    runs = results(spark, [("b", "s", 0.5), ("a", "s", 0.25)])
    store.write_results_json(runs, path)
    back = store.read_results_json(spark, path)
    assert listed(back) == [("b", "s", 0.5), ("a", "s", 0.25)]
    assert store.class_rows(back).count() == 4


def test_ties_keep_store_order(spark):
    runs = store.overall_rows(results(spark, [("x", "s", 0.5), ("b", "s", 0.9), ("a", "s", 0.9)]))
    ranked = leaderboard.rank_runs(runs).orderBy("rank").collect()
    assert [(r["rank"], r.model, r.is_best) for r in ranked] == [(1, "b", True), (2, "a", False), (3, "x", False)]


def test_label_grid_fills_missing_labels(spark):
    classes = store.class_rows(results(spark, [("a", "s", 0.5)])).filter("label = 'normal'").drop(store.STORE_ORDER)
    full = leaderboard.label_grid(classes, LABELS).orderBy("label_ord").collect()
    assert [(r.label, r.f1, r.n) for r in full] == [("normal", 0.5, 6), ("congestion", None, 0)]
    present = leaderboard.label_grid(classes, LABELS, keep_missing=False).collect()
    assert [r.label for r in present] == ["normal"]


def test_first_upsert_creates_the_store_and_the_last_of_a_repeated_run_counts(spark, tmp_path):
    path = str(tmp_path / "new" / "store")
    store.upsert_store(spark, results(spark, [("a", "s", 0.5), ("b", "s", 0.6), ("a", "s", 0.9)]), path)
    assert listed(store.read_store(spark, path)) == [("b", "s", 0.6), ("a", "s", 0.9)]


def test_label_grid_shows_runs_without_classes(spark):
    classes = store.class_rows(results(spark, [("a", "s", 1.0)])).drop(store.STORE_ORDER)
    runs = spark.createDataFrame([("a", "s"), ("b", "s")], "model STRING, strategy STRING")
    full = leaderboard.label_grid(classes, LABELS, runs=runs).orderBy("model", "label_ord").collect()
    assert [(r.model, r.label, r.n) for r in full] == [("a", "normal", 6), ("a", "congestion", 4), ("b", "normal", 0), ("b", "congestion", 0)]


def test_runs_without_a_baseline_stay(spark):
    runs = store.overall_rows(results(spark, [("a", "zero", 0.5), ("a", "few", 0.75), ("b", "few", 0.5)]))
    delta = leaderboard.baseline_delta(runs, F.col("strategy") == "zero", ["model"], ["f1"], ["strategy"])
    got = {(r.model, r.strategy): r.f1_change for r in delta.collect()}
    assert got == {("a", "zero"): 0.0, ("a", "few"): 25.0, ("b", "few"): None}


DOCUMENT = """[
 {"model": "x", "strategy": "one", "metrics": {"f1": 0.75, "precision": 0.75, "recall": 0.75, "exact_match": 0.75, "n": 8},
  "per_class": {"normal": {"f1": 0.8, "precision": 1.0, "recall": 0.6667, "n": 6}, "congestion": {"f1": 0.6667, "precision": 0.5, "recall": 1.0, "n": 2}}},
 {"model": "x", "strategy": "two", "metrics": {"f1": 1.0, "precision": 1.0, "recall": 1.0, "exact_match": 1.0, "n": 8},
  "per_class": {"normal": {"f1": 1.0, "precision": 1.0, "recall": 1.0, "n": 6}, "congestion": {"f1": 1.0, "precision": 1.0, "recall": 1.0, "n": 2}}},
 {"model": "y", "strategy": "one", "metrics": {"f1": 0.75, "precision": 0.75, "recall": 0.75, "exact_match": 0.75, "n": 4},
  "per_class": {"normal": {"f1": 0.8571, "precision": 0.75, "recall": 1.0, "n": 3}, "congestion": {"f1": 0.0, "precision": 0.0, "recall": 0.0, "n": 1}}}
]"""


def test_stored_document(spark, tmp_path):
    """A document as others write it: its sums hold, and the ranking and best picks follow from its scores."""
    (tmp_path / "doc.json").write_text(DOCUMENT)
    runs = store.read_results_json(spark, str(tmp_path / "doc.json"))
    flat, classes = store.overall_rows(runs), store.class_rows(runs)
    sums = classes.groupBy("model", "strategy").agg(F.sum("n").alias("s"), (F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("r"))
    assert flat.join(sums, metrics.RUN).filter("s = n AND abs(r - f1) <= 0.0002").count() == 3
    ranked = leaderboard.rank_runs(flat).orderBy("rank").collect()
    assert [(r.model, r.strategy) for r in ranked] == [("x", "two"), ("x", "one"), ("y", "one")]
    assert {b.model: b.f1 for b in leaderboard.best_per(flat, "model").collect()} == {"x": 1.0, "y": 0.75}


def test_a_write_that_fails_leaves_the_old_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(results(spark, [("a", "s", 0.5), ("b", "s", 0.6)]), path)
    many = results(spark, [(f"m{i}", "s", 0.5) for i in range(40)] + [("a", "s", 0.1)]).repartition(8)
    name = F.when(F.col("model") == "m39", F.raise_error(F.lit("killed in the middle")).cast("string")).otherwise(F.col("model"))
    with pytest.raises(Exception, match="killed in the middle"):
        store.upsert_store(spark, many.withColumn("model", name), path)
    assert listed(store.read_store(spark, path)) == [("a", "s", 0.5), ("b", "s", 0.6)]


def test_a_write_that_is_killed_before_its_pointer_leaves_the_old_store(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.write_store(results(spark, [("a", "s", 0.5)]), path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(store, "put_new", killed)
        with pytest.raises(KeyboardInterrupt):
            store.upsert_store(spark, results(spark, [("a", "s", 0.9), ("b", "s", 0.9)]), path)
    assert listed(store.read_store(spark, path)) == [("a", "s", 0.5)]
    assert len(list((tmp_path / "store" / store.ROWS).iterdir())) == 2
    held = store.read_store(spark, path)
    store.upsert_store(spark, results(spark, [("c", "s", 0.1)]), path)
    # what the killed writer left goes; the commit before stays readable
    assert listed(held) == [("a", "s", 0.5)]
    assert listed(store.read_store(spark, path)) == [("a", "s", 0.5), ("c", "s", 0.1)]
    assert len(list((tmp_path / "store" / store.ROWS).iterdir())) == 2


@pytest.mark.parametrize("rivals", [1, 3])
def test_a_second_writer_on_the_same_base_is_refused(spark, tmp_path, monkeypatch, rivals):
    path = str(tmp_path / "store")
    store.write_store(results(spark, [("a", "s", 0.5)]), path)
    put = store.put_new

    def overtaken(*args):
        monkeypatch.setattr(store, "put_new", put)
        for i in range(rivals):
            store.upsert_store(spark, results(spark, [(f"rival{i}", "s", 0.7)]), path)
        return put(*args)

    monkeypatch.setattr(store, "put_new", overtaken)
    with pytest.raises(store.StoreConflict):
        store.upsert_store(spark, results(spark, [("late", "s", 0.9)]), path)
    want = [("a", "s", 0.5), *[(f"rival{i}", "s", 0.7) for i in range(rivals)]]
    assert listed(store.read_store(spark, path)) == want
    store.upsert_store(spark, results(spark, [("late", "s", 0.9)]), path)
    assert listed(store.read_store(spark, path)) == [*want, ("late", "s", 0.9)]


def test_a_store_is_created_once_and_read_only_if_there(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, path)
    store.write_store(results(spark, [("a", "s", 0.5)]), path)
    with pytest.raises(store.StoreConflict):
        store.write_store(results(spark, [("b", "s", 0.5)]), path)
