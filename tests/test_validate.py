import json

from gradeline.functions.vocab import SIGNALLING
from gradeline.operators import validate as V
from gradeline.sources import jsonl

CASES = [
    ('{"log": "x", "root_cause": ["congestion"]}', None, "x", ["congestion"]),
    ('{"root_cause": ["a", 1, null], "log": "x", "extra": {"k": []}}', None, "x", ["a"]),
    ('{"log": null, "root_cause": ["a"]}', None, None, ["a"]),
    ('{"log": "x", "log": "y", "root_cause": ["a"]}', None, "y", ["a"]),
    ('{"log": "x\\ny", "root_cause": [{"a": 1}]}', None, "x\ny", []),
    ('{"log": "x"}', "missing key", None, None),
    ('{"root_cause": ["a"]}', "missing key", None, None),
    ('{"log": "x", "root_cause": null}', "root_cause is not a list", None, None),
    ('{"log": "x", "root_cause": "a"}', "root_cause is not a list", None, None),
    ('{"log": "x", "root_cause": {"a": 1}}', "root_cause is not a list", None, None),
    ('{"log": "x", "root_cause": []}', "root_cause is empty", None, None),
    ('{"log": "x", "root_cause": ["a"]', "not a JSON object", None, None),
    ('{"log": "x", "root_cause": ["a"]} tail', "not a JSON object", None, None),
    ('{"log": "x", "root_cause": ["a"]}] tail', "not a JSON object", None, None),
    ('{"log": "x", "root_cause": ["a"]}, {"log": "y"}', "not a JSON object", None, None),
    ('{"log": "x", "root_cause": ["a"]},{"root_cause": "b"}]', "not a JSON object", None, None),
    ('{"log": "x", "root_cause": ["a",]}', "not a JSON object", None, None),
    ('{"log": "x", "root_cause": ["a" 1]}', "not a JSON object", None, None),
    ('{"log": "x", "root_cause": ["a"], "log": [1 2]}', "not a JSON object", None, None),
    ('{"log": "x", "root_cause": ["a"], "more": {"k": }}', "not a JSON object", None, None),
    ('{"log": "x", "root_cause": ["a", 1, null], "more": 2}', None, "x", ["a"]),
    ("['log', 'root_cause']", "not a JSON object", None, None),
    ('["log", "root_cause"]', "not a JSON object", None, None),
    ('"log root_cause"', "not a JSON object", None, None),
    ("", "not a JSON object", None, None),
    (None, "not a JSON object", None, None),
]


def test_records(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i INT, generated STRING")
    got = {r.i: r for r in V.parse_records(df).collect()}
    for i, (text, reason, log, codes) in enumerate(CASES):
        assert got[i].reason == reason, text
        if reason is None:
            assert (got[i].log, got[i].root_cause) == (log, codes), text


def test_label_rule_and_counts(spark):
    rows = [("congestion", CASES[0][0]), ("normal", CASES[0][0]), ("normal", "junk")]
    df = spark.createDataFrame(rows, "asked STRING, generated STRING")
    parsed = V.parse_records(df, vocab=SIGNALLING, expected="asked")
    assert sorted(map(tuple, V.quarantine_report(parsed, ["asked"]).collect())) == [
        ("normal", "label differs", 1), ("normal", "not a JSON object", 1),
    ]
    assert [tuple(r) for r in V.written_and_skipped(parsed, []).collect()] == [(1, 2)]
    assert V.valid_records(parsed).count() == 1


def test_whole_records_survive(spark, tmp_path):
    text = '{"log": "x\\ny",\n "root_cause": ["a", 1, null],\r\n "more": {"k": [true]}}'
    parsed = V.parse_records(spark.createDataFrame([(text,), ("junk",)], "generated STRING"))
    path = str(tmp_path / "records")
    jsonl.write_records(V.valid_records(parsed), path)
    (row,) = jsonl.read_records(spark, path).selectExpr("log", "root_cause", "to_json(record) AS record").collect()
    assert (row.log, row.root_cause) == ("x\ny", ["a"])
    assert json.loads(row.record) == {"log": "x\ny", "root_cause": ["a", 1, None], "more": {"k": [True]}}


def test_records_are_parsed_once(spark):
    df = spark.createDataFrame([("junk", "a")], "generated STRING, label STRING")
    parsed = V.parse_records(df)
    for result in (V.valid_records(parsed), V.quarantine_report(parsed, ["label"]), V.written_and_skipped(parsed, ["label"])):
        assert result._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
