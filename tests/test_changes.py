"""Differences between stores, families and extractions; counted writes; repeated keys; the collapse alarm."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gradeline.functions.vocab import SIGNALLING
from gradeline.operators import leaderboard, metrics, validate
from gradeline.operators import runlogs
from gradeline.sources import jsonl, results_store
from gradeline.sources import runlogs as logs
from gradeline.sources.workspace import exists, fresh_path, scratch, stage
from gradeline.streaming import jobs

RECORDS = [
    '{"log":"x","root_cause":["a"],"log":"y"}',
    '{"log":"x","root_cause":["a"],"e":{"q":1,"q":2}}',
    '{"log":{"q":1,"q":2},"root_cause":["a","b"]}',
    '{"root_cause":[],"log":"x","root_cause":["c",{"k":1,"k":3}]}',
    '{"log":"x"}',
    "no record",
]


def parsed_records(spark):
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(RECORDS)], "ex_id INT, generated STRING")
    return validate.parse_records(rows.withColumns({c: F.lit("old") for c in ("log", "reason", "a.b")}))


def test_of_a_repeated_key_the_last_value_counts(spark):
    parsed = parsed_records(spark)
    assert sorted(parsed.columns) == sorted(["ex_id", "generated", "a.b", "record", "log", "root_cause", "reason"])
    rows = {r["ex_id"]: r for r in parsed.collect()}
    assert [rows[k]["reason"] for k in range(6)] == [None] * 4 + ["missing key", "not a JSON object"]
    assert rows[0]["log"] == "y" and rows[3]["root_cause"] == ["c"]
    path = fresh_path(spark, "records")
    jsonl.write_records(validate.valid_records(parsed), path)
    read = jsonl.read_records(spark, path).select("log", "root_cause", F.to_json("record").alias("record")).collect()
    want = [json.loads(r) for r in RECORDS[:4]]  # keeps the last value as well
    plain = lambda rs: sorted(json.dumps(r, sort_keys=True) for r in rs)
    assert plain(json.loads(r["record"]) for r in read) == plain(want)
    assert sorted(tuple(r["root_cause"]) for r in read) == [("a",), ("a",), ("a", "b"), ("c",)]


def test_judged_records_are_written_and_counted_in_one_pass(spark):
    path, source = fresh_path(spark, "judged"), fresh_path(spark, "source")
    parsed_records(spark).select("ex_id", "generated").write.parquet(source)
    parsed = validate.parse_records(spark.read.parquet(source))
    assert parsed._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert jsonl.write_judged(parsed, path) == (4, 2)
    lines = spark.read.schema("value STRING, kind STRING").text(path).collect()
    assert sorted(r["kind"] for r in lines) == ["quarantined"] * 2 + ["valid"] * 4
    bad = [json.loads(r["value"]) for r in lines if r["kind"] == "quarantined"]
    assert sorted((b["reason"], b["text"]) for b in bad) == [("missing key", '{"log":"x"}'), ("not a JSON object", "no record")]


def test_counts_of_no_records(spark):
    empty = parsed_records(spark).limit(0)
    assert jsonl.write_judged(empty, fresh_path(spark, "judged")) == (0, 0)


def test_families_are_longest_names_up_to_a_joint(spark):
    runs = spark.createDataFrame([(n, 0.5) for n in ("a", "a-x", "a-x-y", "ab", "a-", "-", "", "b-a", None, "a-x.y")], "model STRING, f1 DOUBLE")
    families = spark.createDataFrame([(n,) for n in ("a", "a-x", "a-x", "b", "", None)], "family STRING")
    found = {r["model"]: r["family"] for r in leaderboard.with_family(runs, families).collect()}
    assert found == {"a": "a", "a-x": "a-x", "a-x-y": "a-x", "ab": None, "a-": "a", "-": "", "": "", "b-a": "b", None: None, "a-x.y": "a"}
    plan = leaderboard.with_family(runs, families)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_family_delta_by_strategy(spark):
    runs = spark.createDataFrame(
        [("q", "slm", 0.2), ("q-x", "slm", 0.7), ("q-x", "few", 0.9), ("z", "slm", 0.1)], "model STRING, strategy STRING, f1 DOUBLE"
    )
    families = spark.createDataFrame([("q",)], "family STRING")
    rows = {(r["model"], r["strategy"]): (r["family"], r["f1_change"]) for r in leaderboard.family_delta(runs, families, ["strategy"], ["f1"]).collect()}
    assert rows == {("q", "slm"): ("q", 0.0), ("q-x", "slm"): ("q", 50.0), ("q-x", "few"): ("q", None), ("z", "slm"): (None, None)}


def store(spark, runs):
    rows = [(m, "s", {"f1": f, "precision": f, "recall": f, "exact_match": f, "n": n}, classes, k) for k, (m, f, n, classes) in enumerate(runs)]
    return spark.createDataFrame(rows, f"{results_store.RESULTS}, store_ord BIGINT")


def test_store_difference_goes_down_to_numbers(spark):
    score = {"f1": 0.5, "precision": 0.5, "recall": 0.5, "n": 4}
    before = store(spark, [("same", 0.5, 4, {"a": score, "b": score}), ("gone", 0.1, 1, {}), ("other", 0.3, 2, {"a": score, "b": score}), ("null", None, 1, None)])
    after = store(spark, [("null", None, 1, None), ("other", 0.3, 3, {"b": {**score, "f1": None}, "c": score}), ("new", 0.9, 9, {}), ("same", 0.5, 4, {"b": score, "a": score})])
    rows = [tuple(r) for r in results_store.store_diff(before, after).select("model", "status", "path", "before", "after").collect()]
    whole = sorted(r for r in rows if r[1] != "changed")
    assert whole == [("gone", "removed", None, None, None), ("new", "added", None, None, None), ("null", "equal", None, None, None), ("same", "equal", None, None, None)]
    changed = {r[2]: r[3:] for r in rows if r[1] == "changed"}
    want = {"metrics.n": (2.0, 3.0), "per_class.b.f1": (0.5, None)}
    want |= {f"per_class.a.{f}": (v, None) for f, v in score.items()} | {f"per_class.c.{f}": (None, v) for f, v in score.items()}
    assert changed == {k: tuple(map(lambda x: None if x is None else float(x), v)) for k, v in want.items()}
    assert results_store.store_diff(before.limit(0), after.limit(0)).collect() == []


def test_flips_add_up(spark):
    rows = spark.createDataFrame([("m", "s", "a", "b"), ("m", "s", "a", "a"), ("m", "s", None, "a"), ("m", "t", "b", "b")], "model STRING, strategy STRING, old STRING, new STRING")
    found = {(r["strategy"], r["label"]): (r["n_before"], r["n_after"], r["gained"], r["lost"]) for r in metrics.label_flips(rows, "old", "new").collect()}
    assert found == {("s", "a"): (2, 2, 1, 1), ("s", "b"): (0, 1, 1, 0), ("s", None): (1, 0, 0, 1), ("t", "b"): (1, 1, 0, 0)}
    plan = metrics.label_flips(rows, "old", "new")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_collapse_alarm_over_files_with_late_rows(spark, tmp_path):
    """One run collapses in two of six windows of a day; a row later than the watermark allows changes nothing."""
    def row(run, hour, label, minute=0, day=1):
        return {"run_id": run, "ts": f"2024-01-{day:02}T{hour:02}:{minute:02}:00", "label": label}

    first = [row("r", h, "normal" if h < 8 else "jitter", m) for h in range(24) for m in (0, 20, 40)] + [row("q", 3, "jitter"), row("q", 3, None)]
    late = [row("r", 12, "jitter", day=5), row("r", 9, "normal"), row("r", 9, "normal")]
    for k, part in enumerate((first, [row("r", 12, "normal", day=3)], [row("r", 12, "normal", day=4)], late)):
        (tmp_path / f"part-{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(tmp_path / f"part-{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("run_id STRING, ts TIMESTAMP, label STRING").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    windows = jobs.collapse_windows(stream, "label", SIGNALLING.default, "run_id", width="4 hours", limit=0.9, least=3)
    out, state = fresh_path(spark, "alarms"), fresh_path(spark, "state")
    jobs.append_to(jobs.collapse_alarm(windows, "run_id", least_windows=2), out, state, available_now=True).awaitTermination()
    alarms = [(r["run_id"], str(r["period_start"])[:10], r["n_windows"], r["n_collapsed"], r["n"]) for r in spark.read.parquet(out).collect()]
    assert alarms == [("r", "2024-01-01", 6, 2, 72)]


def test_scratch_tables_go_and_lasting_ones_stay(spark):
    with scratch():
        with scratch():
            gone = stage(spark.range(3), "gone")
            kept = stage(spark.range(4), "kept", lasting=True)
            paths = [f.inputFiles()[0].rsplit("/", 1)[0] for f in (gone, kept)]
        assert [exists(spark, p) for p in paths] == [False, True] and kept.count() == 4
    assert not exists(spark, paths[1])
    with pytest.raises(ZeroDivisionError), scratch():
        path = stage(spark.range(3), "gone").inputFiles()[0].rsplit("/", 1)[0]
        raise ZeroDivisionError
    assert not exists(spark, path)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_artifacts_are_listed_from_storage_without_their_content(spark, tmp_path, scheme):
    base = tmp_path / "output"
    for name, size in (("m/train-2/model.bin", 5), ("m/train-10/model.bin", 7), ("m/train-10/x/y.bin", 1), ("n/a b/model.bin", 3), ("top.bin", 2), ("m/train-9/log.txt", 9)):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(b"x" * size)
    listing = logs.list_artifacts(spark, f"{scheme}{base}/", files="*.bin")
    got = {(r.slug, r.prefix): (r.n_files, r.n_bytes) for r in listing.collect()}
    assert got == {("m", "m/train-2/"): (1, 5), ("m", "m/train-10/"): (1, 7), ("m", "m/train-10/x/"): (1, 1), ("n", "n/a b/"): (1, 3)}
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "content" not in plan.split("ReadSchema")[1].splitlines()[0]
    latest = {r.slug: r.latest for r in runlogs.latest_artifacts(listing.filter("prefix LIKE '%/train-%/' AND prefix NOT LIKE '%/%/%/'")).collect()}
    assert latest == {"m": "m/train-2/"}
