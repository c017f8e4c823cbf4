import json

import pytest
from pyspark.sql import functions as F

from gradeline.functions import text as X

FENCE = X.FENCE


@pytest.mark.parametrize(
    "text, inner",
    [
        ('{"a": 1}', '{"a": 1}'),
        (f'{FENCE}json\n{{"a": 1}}\n{FENCE}', '{"a": 1}'),
        (f"\n {FENCE}\nx\n{FENCE} and more", "x"),
        (f"{FENCE}jsonx", "x"),
        (f"{FENCE} json x{FENCE}", "json x"),
        (f"see {FENCE}x{FENCE}", f"see {FENCE}x{FENCE}"),
        (FENCE, ""),
        ("", ""),
    ],
)
def test_strip_fence(spark, text, inner):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(X.strip_fence(F.col("t"))).first()[0] == inner


def test_slug_and_percent(spark):
    df = spark.createDataFrame([("acme/Some_Model-7.5B", 0.9083), ("plain", 1.0)], "m STRING, v DOUBLE")
    got = df.select(X.slug(F.col("m")), X.slug(F.col("m"), 6), X.percent(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("some-model-7-5b", "some-m", "90.83%"), ("plain", "plain", "100.00%")]


def test_ratio_sends_halves_to_even_and_zero_to_zero(spark):
    df = spark.createDataFrame([(1, 32), (3, 32), (1, 3), (2, 3), (5, 0), (1, 160)], "a BIGINT, b BIGINT")
    got = [r[0] for r in df.select(X.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0312, 0.0938, 0.3333, 0.6667, 0.0, 0.0062]


@pytest.mark.parametrize("items", [["a", "b"], [], ['say "x"'], ["back\\slash"], ["tab\t", "line\n"], ["a", None]])
def test_json_list_is_spelled_as_python_does(spark, items):
    df = spark.createDataFrame([(items,)], "x ARRAY<STRING>")
    assert df.select(X.json_string_list(F.col("x"))).first()[0] == json.dumps(items)


def test_json_list_of_other_alphabets_reads_back(spark):
    df = spark.createDataFrame([(["été", "中"],)], "x ARRAY<STRING>")
    spelled = df.select(X.json_string_list(F.col("x"))).first()[0]
    assert spelled.isascii() and json.loads(spelled) == ["été", "中"]
