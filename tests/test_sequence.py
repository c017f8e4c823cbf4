"""Ordered operators against brute force, with one group that holds most rows."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeline.operators import schedule, sequence

ROWS = 3000


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i * 7 % ROWS, rng.randint(-5, 5)) for i in range(ROWS)]
    df = spark.createDataFrame(rows, "g STRING, t BIGINT, v BIGINT").repartition(5)
    groups = {}
    for g, t, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((t, v))
    return df, groups


@pytest.fixture(params=["coalesced", "many ranges"])
def ranges(request, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == "coalesced").lower())
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ordinals(data, ranges):
    df, groups = data
    got = sequence.dense_ordinals(df, ["t"], ["g"], total="size").collect()
    want = {(g, t): (i, len(rows)) for g, rows in groups.items() for i, (t, _) in enumerate(rows)}
    assert len(got) == ROWS
    assert {(r.g, r.t): (r.ord, r["size"]) for r in got} == want


def test_ordinals_of_one_sequence(data, ranges):
    got = sequence.dense_ordinals(data[0], ["t"]).collect()
    assert all(r.ord == r.t for r in got) and len(got) == ROWS


def test_running_totals(data, ranges):
    df, groups = data
    got = sequence.running_totals(df, {"total": "v"}, ["t"], ["g"]).collect()
    want = {}
    for g, rows in groups.items():
        total = 0
        for i, (t, v) in enumerate(rows):
            total += v
            want[g, t] = (i, total, v)
    assert {(r.g, r.t): (r.ord, r.total, r.v) for r in got} == want


def test_previous_values(data, ranges):
    df, groups = data
    got = sequence.previous_values(df, {"pv": "v", "pt": "t"}, ["t"], ["g"]).collect()
    want = {}
    for g, rows in groups.items():
        for before, (t, _) in zip([(None, None), *rows], rows):
            want[g, t] = (before[1], before[0])
    assert {(r.g, r.t): (r.pv, r.pt) for r in got} == want


def test_previous_value_may_be_null(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "t INT, v DOUBLE")
    got = {r.t: r.p for r in sequence.previous_values(df, {"p": "v"}, ["t"]).collect()}
    assert got == {1: None, 2: None, 3: 5.0}


def test_running_totals_of_nulls_decimals_and_doubles(spark, ranges):
    """A sum is null until a value is met, also if that was in an earlier range; batches of 7 rows cut sequences."""
    rng = random.Random(8)
    rows = []
    for g, n in (("a", 40), (None, 900), ("c", 3), ("d", 60)):
        rows += [(g, t, None if g == "d" or rng.random() < 0.3 else Decimal(rng.randint(-999, 999)) / 100, rng.random()) for t in range(n)]
    df = spark.createDataFrame(rows, "g STRING, t INT, v DECIMAL(8,2), x DOUBLE").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.g, r.t): r for r in sequence.running_totals(df, {"total": "v", "mass": "x"}, ["t"], ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for g in ("a", None, "c", "d"):
        total, mass = None, 0.0
        for i, (_, t, v, x) in enumerate(r for r in rows if r[0] == g):
            total = total if v is None else v + (total or 0)
            mass += x
            row = got[g, t]
            assert (row.ord, row.total, row.v) == (i, total, v) and row.mass == pytest.approx(mass)


def test_scan_of_an_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "g STRING, t INT, v INT")
    assert sequence.running_totals(empty, {"total": "v"}, ["t"], ["g"]).collect() == []
    assert sequence.previous_values(empty, {"p": "v"}, ["t"]).collect() == []
    named = spark.createDataFrame([("g", 2, 5, "x"), ("g", 1, 4, "y")], "g STRING, t INT, `0` INT, start STRING")
    got = {r.t: (r.total, r.start) for r in sequence.running_totals(named, {"total": "0"}, ["t"], ["g"]).collect()}
    assert got == {1: (4, "y"), 2: (9, "x")}
    assert {r.t: r.p for r in sequence.previous_values(named, {"p": "start"}, ["t"], ["g"]).collect()} == {1: None, 2: "y"}


def test_sums_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(1, 2**62), (2, 2**62), (3, 2**62)], "t INT, v BIGINT")
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        sequence.running_totals(df, {"total": "v"}, ["t"]).collect()
    fits = spark.createDataFrame([(1, 2**62), (2, -(2**62)), (3, 2**62)], "t INT, v BIGINT")
    got = [r.total for r in sequence.running_totals(fits, {"total": "v"}, ["t"]).orderBy("t").collect()]
    assert got == [2**62, 0, 2**62]


def test_rows_move_once(data):
    """One exchange, by ranges, up to the written table; after it only sums per range move, and one row per range is handed out."""
    df = data[0]
    written = sequence._scanned(df, ["g"], ["t"], {"n": F.lit(1)}, {"pv": "v"})
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange rangepartitioning", plan)) == 1
    assert len(re.findall(r"Exchange (?!Round)", plan)) == 1  # the test's own repartition(5) aside
    for found in (sequence.running_totals(df, {"s": "v"}, ["t"], ["g"]), sequence.previous_values(df, {"p": "v"}, ["t"], ["g"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert moved and not [line for line in moved if re.search(r"hashpartitioning\([^)]*\bt#", line)]
        assert not re.search(r"SortMergeJoin|ShuffledHashJoin", plan) and "BroadcastHashJoin" in plan


def test_mini_batches(data):
    got = sequence.mini_batches(data[0], 64, ["t"]).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in got} == {b: min(64, ROWS - 64 * b) for b in range(-(-ROWS // 64))}


def test_schedule_is_balanced(spark):
    counts = {r.label: r["count"] for r in schedule.balanced_schedule(spark, 1300).groupBy("label").count().collect()}
    assert sorted(counts.values()) == [162] * 4 + [163] * 4
    assert [k for k, v in counts.items() if v == 163 and k in schedule.SIGNALLING.labels[:4]].__len__() == 4


def test_shuffle_depends_on_the_seed_only(spark):
    df = spark.range(500)
    one = {r.id: r.place for r in schedule.seeded_shuffle(df, 42, "id").collect()}
    two = {r.id: r.place for r in schedule.seeded_shuffle(df.repartition(3), 42, "id").collect()}
    other = {r.id: r.place for r in schedule.seeded_shuffle(df, 99, "id").collect()}
    assert one == two != other
    assert sorted(one.values()) == sorted(other.values()) == list(range(500))
