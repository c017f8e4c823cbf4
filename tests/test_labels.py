"""Label extraction, one case per branch and per trap."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeline.functions import labels as L
from gradeline.functions import text as X
from gradeline.functions.vocab import SIGNALLING, Vocabulary
from gradeline.operators.codes import filter_noise_rows
from gradeline.plans.fixtures import QUALITY

CASCADE = [
    ('["congestion"]', ["congestion"], "json"),
    ('["Congestion ", "HARQ_NACK", "radio_failure", "congestion"]', ["congestion", "radio_failure"], "json"),
    ("['congestion']", ["congestion"], "named"),
    ('["abnormal"]', ["normal"], "json"),
    ('["normal"]', ["normal"], "json"),
    ('[["congestion"]]', ["congestion"], "named"),
    ("[]", ["normal"], "default"),
    ("[1, null, true]", ["normal"], "default"),
    ('[{"a": "normal"}]', ["normal"], "json"),
    ('["\\u006eormal"] with RLF', ["normal"], "json"),
    ('["HEARTBEAT_TIMEOUT"]', ["normal"], "default"),
    ('["HEARTBEAT_TIMEOUT"] after RLF', ["radio_failure"], "phrase"),
    ('[AMF] text ["congestion"]', ["congestion"], "named"),
    ('["congestion",]', ["congestion"], "named"),
    ('["overload"', ["congestion"], "phrase"),
    ('[\n "qos_violation"\n]', ["qos_violation"], "json"),
    ("<think>congestion</think>", ["congestion"], "named"),
    ("<think>congestion</think> radio_failure", ["radio_failure"], "named"),
    ("<think>a</think>radio_failure<think>congestion", ["radio_failure"], "named"),
    ("<think>only congestion here", ["congestion"], "named"),
    ("<thi<think>x</think>nk>congestion and RLF", ["congestion"], "named"),
    ("normal, but RLF seen", ["radio_failure"], "phrase"),
    ("normal", ["normal"], "default"),
    ("normal or congestion", ["normal", "congestion"], "named"),
    ("RADIO_FAILURE then CORE_NETWORK_FAILURE", ["core_network_failure", "radio_failure"], "named"),
    ("beam failure recovery", ["normal"], "default"),
    ("beam failure", ["radio_failure"], "phrase"),
    ("beam failure recovery, beam  failure again", ["radio_failure"], "phrase"),
    ("AMF fail, auth ok", ["normal"], "default"),
    ("AMF fail\nauth ok", ["core_network_failure"], "phrase"),
    ("AMF link\rfail", ["core_network_failure"], "phrase"),
    ("AMF link fail", ["core_network_failure"], "phrase"),
    ("AMF link\nfail", ["normal"], "default"),
    ("radio conditions poor", ["radio_failure"], "phrase"),
    ("radio\x1cconditions poor", ["radio_failure"], "phrase"),
    ("overload and then jitter", ["congestion", "transport_jitter"], "phrase"),
    ("cause value 21, cause 22", ["authentication_failure", "congestion"], "phrase"),
    ("AſU tranſmiſſİon error", ["transport_jitter"], "phrase"),
    ("Known oVerload", ["congestion"], "phrase"),
    ("", ["normal"], "default"),
    ("   \n", ["normal"], "default"),
    (None, None, None),
]


def test_cascade_cases(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(CASCADE)]
    df = spark.createDataFrame(rows, "i INT, output STRING")
    got = {r.i: (r.codes, r.step) for r in L.extract_labels(df, out="codes", decided_by="step").collect()}
    wrong = [(t, got[i], (c, s)) for i, (t, c, s) in enumerate(CASCADE) if got[i] != (c, s)]
    assert wrong == []


@pytest.mark.parametrize(
    "codes, kept",
    [
        (["HARQ_NACK", " Congestion", "congestion", "x", None], ["congestion"]),
        ([], ["normal"]),
        (["HARQ_NACK"], ["normal"]),
        (["radio_failure", " CONGESTION\x1f", "radio_failure"], ["radio_failure", "congestion"]),
        (None, ["normal"]),
    ],
)
def test_noise_filter(spark, codes, kept):
    df = spark.createDataFrame([(codes,)], "codes ARRAY<STRING>")
    once = df.select(L.filter_noise(F.col("codes")).alias("codes"))
    assert once.first().codes == kept
    assert once.select(L.filter_noise(F.col("codes"))).first()[0] == kept


def test_noise_wins_over_a_label_of_the_same_name(spark):
    vocab = Vocabulary(labels=("alarm", "ok"), default="ok", noise=("ALARM",), synonyms=(("siren", "alarm"),))
    df = spark.createDataFrame([('["alarm"]',), ("alarm",), ("siren",)], "output STRING")
    assert [r.c for r in L.extract_labels(df, vocab=vocab, out="c").collect()] == [["ok"]] * 3


def test_numbers_are_not_string_labels(spark):
    df = spark.createDataFrame([(0, "[1]"), (1, '["1"]'), (2, '[true, "1"]')], "i INT, output STRING")
    found = L.with_json_labels(df.withColumn("answer", F.col("output")), vocab=QUALITY).orderBy("i")
    assert [r.json_labels for r in found.collect()] == [None, ["1"], ["1"]]


def test_prediction_choice(spark):
    rows = [([], None), (None, "RLF"), (["congestion"], "RLF"), ([], ""), (["HARQ_NACK"], "RLF")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, root_cause ARRAY<STRING>, output STRING")
    chosen = L.choose_prediction(df).orderBy("i").select("predicted", L.primary_label(F.col("predicted")).alias("p"))
    assert [(r.predicted, r.p) for r in chosen.collect()] == [
        (["normal"], "normal"),
        (["radio_failure"], "radio_failure"),
        (["congestion"], "congestion"),
        (["normal"], "normal"),
        (["HARQ_NACK"], "normal"),
    ]
    again = L.choose_prediction(df, reextract=True).orderBy("i").collect()
    assert [r.predicted for r in again][2] == ["radio_failure"]


def test_synonyms_of_mixed_order_keep_first_hit_order(spark):
    vocab = Vocabulary(labels=("a1", "b1", "none"), default="none",
                       synonyms=(("xx", "b1"), ("yy", "a1"), ("zz", "b1"), ("ww", "unknown"), ("ww", "none")))
    df = spark.createDataFrame([(0, "yy zz"), (1, "zz xx yy"), (2, "ww"), (3, "zz")], "i INT, output STRING")
    got = [r.c for r in L.extract_labels(df, vocab=vocab, out="c").orderBy("i").collect()]
    assert got == [["a1", "b1"], ["b1", "a1"], ["none"], ["b1"]]


PATTERNS = [p for p, _ in SIGNALLING.synonyms]


def folded(text: str) -> str:
    return text.lower().translate({0x17F: "s", 0x131: "i", 0x307: None})


@pytest.mark.parametrize("pattern", [*PATTERNS, r"ab?c", r"x{2}y", r"a|b", r"(foo)bar", r"foo\d+bar", "naïve word"])
@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_required_words_are_in_every_match(pattern, data):
    text = data.draw(st.from_regex(re.compile(pattern, re.IGNORECASE)))
    assert all(word in folded(text) for word in X.required_words(pattern))


def test_phrase_search_equals_python_search(spark):
    texts = ["x"]
    for pattern in PATTERNS:
        words = X.required_words(pattern)
        texts += [f" {j} ".join(words) for j in (" ", "\n", "\r", " ", " and ")] + [" ".join(reversed(words))]
        texts += ["  ".join(words).upper(), " ".join(words).replace("s", "ſ").replace("i", "ı")]
        texts += [f"{'.'.join(words)} recovery auth", "　".join(words)]
    texts = sorted(set(texts))
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").withColumn("f", X.fold_for_words(F.lower("t")))
    hits = df.select("t", F.array(*[F.expr(X.mentions("t", "f", p)) for p in PATTERNS]).alias("hits")).collect()
    wrong = [
        (r.t, p, hit) for r in hits for p, hit in zip(PATTERNS, r.hits) if hit != bool(re.search(p, r.t, re.IGNORECASE))
    ]
    assert wrong == []


def test_rows_of_codes_with_one_large_group(spark):
    rows = [("hot", i, c) for i, c in enumerate(["HARQ_NACK", " Radio_Failure", "x", "congestion"] * 500)]
    rows += [("noise", 1, "HARQ_NACK"), ("late", 9, "normal"), ("late", 2, "CONGESTION")]
    df = spark.createDataFrame(rows, "g STRING, t INT, code STRING")
    got = {r.g: r.codes for r in filter_noise_rows(df, ["g"], "code", ["t"]).collect()}
    assert got == {"hot": ["radio_failure", "congestion"], "noise": ["normal"], "late": ["congestion", "normal"]}


def test_long_answers_are_read_to_the_end(spark):
    filler = "word " * 60_000
    rows = [
        (0, "<think>" * 30_000 + "x"),
        (1, "[" * 60_000 + " congestion"),
        (2, filler + "RLF"),
        (3, filler + '["qos_violation"]'),
        (4, "<think>" + filler + "</think>" + filler + "radio_failure"),
        (5, "\n" * 60_000 + "jitter" + " " * 60_000),
    ]
    df = spark.createDataFrame(rows, "i INT, output STRING").repartition(6)
    got = {r.i: r.c[0] for r in L.extract_labels(df, out="c").collect()}
    assert got == {
        0: "normal", 1: "congestion", 2: "radio_failure", 3: "qos_violation", 4: "radio_failure", 5: "transport_jitter",
    }
