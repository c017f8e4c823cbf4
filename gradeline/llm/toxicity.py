"""Toxic documents by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are densities of word lists, the same after undoing letter substitutions, hits near a
second person, capitals, punctuation, and shares of disguised and stretched words. Besides the lists below there is
one of words and word beginnings that is learnt from the labels, as no fixed list covers all languages. The features
are computed for every whole text and written once. The list, the trees and the calibration are fitted on
three separate parts of a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_row, small_batches, stage

TRAINING_ROWS = 20_000
LEARNT_TERMS = 2_000
LEAST_DOCUMENTS = 3
LEAST_RATIO = 8.0
BEGINNINGS = (4, 5, 6)
LIMIT = 0.7
NEAR_WORDS = 5
CACHED_WORDS = 50_000

INSULTS = frozenset(
    "airhead arsehole asshole bastard bitch bonehead bozo brute buffoon chump clown coward creep cretin crook deadbeat degenerate"
    " dimwit disgrace disgusting dolt dope dork douche dumb dumbass dummy dunce failure fool freak garbage goon hypocrite idiot"
    " idiotic imbecile jackass jerk joke kook lame liar loser lowlife lunatic maggot moron moronic numbskull nutcase oaf parasite"
    " pathetic pig psycho punk rat retard rubbish scoundrel scum scumbag simpleton slob snake stupid sucker swine thug trash"
    " troll twit useless vermin vile weirdo wimp worthless wretch"
    " abschaum arschloch depp dummkopf idiotin trottel versager wertlos"
    " connard cretino crétin imbécile ordure pitoyable salaud stupide"
    " basura cabrón estúpido gilipollas inútil patético payaso tonto".split()
)
PROFANE = frozenset(
    "bollocks bullshit crap cunt damn dick fuck fucked fucker fucking goddamn motherfucker piss prick shit shitty slut twat wanker"
    " whore scheisse scheiße merde putain mierda puta".split()
)
HOSTILE = frozenset(
    "burn choke destroy die drown hang hate hurt kill murder punch rape rot shoot slaughter stab strangle suffer suicide".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself youre you're u ur ya du dich dir dein deine euch tu toi te ton ta vous votre tú ti usted ustedes vosotros".split()
)
#: Characters that stand for letters.
DISGUISE = str.maketrans("013457@$!|+€", "oieastasiite")
FILLERS = str.maketrans("", "", "*._-~^'`")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
INSULT, PROFANITY, HOSTILITY, PERSON, HIDDEN, DISGUISED, STRETCHED, SHOUTED = (1 << i for i in range(8))

FEATURES = (
    "log_words", "insult_density", "insult_hits", "profane_density", "profane_hits", "hostile_density", "hidden_density",
    "hidden_hits", "person_density", "hits_near_person", "near_person_density", "densest_window", "capital_share",
    "shouted_share", "exclamation_share", "punctuation_share", "disguised_share", "stretched_share", "learnt_hits",
    "learnt_density", "learnt_weight", "strongest_learnt",
)


def _stretched(word: str) -> bool:
    return any(word[i] == word[i + 1] == word[i + 2] and word[i].isalpha() for i in range(len(word) - 2))


def _plain(word: str) -> str:
    """The word with letter substitutions, fillers and stretched letters undone."""
    out: list[str] = []
    for c in word.translate(DISGUISE).translate(FILLERS):
        if not (len(out) > 1 and out[-1] == out[-2] == c):
            out.append(c)
    return "".join(out)


def _single(word: str) -> str:
    return "".join(c for i, c in enumerate(word) if not i or word[i - 1] != c)


SINGLE = {kind: frozenset(map(_single, words)) for kind, words in ((INSULT, INSULTS), (PROFANITY, PROFANE))}


def _lists(word: str) -> int:
    return (
        INSULT * (word in INSULTS or word.endswith("s") and word[:-1] in INSULTS)
        | PROFANITY * (word in PROFANE) | HOSTILITY * (word in HOSTILE) | PERSON * (word in SECOND_PERSON)
    )


def terms_of(word: str) -> list[str]:
    """A plain word and its beginnings, which end in a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)] if word.isalpha() else []


class WordKinds(dict):
    """What is known of a word: the bits above, and its weight in the learnt list in eighths above them; remembered up to a bound."""

    def __init__(self, learnt: dict[str, float]):
        super().__init__()
        self.learnt = learnt

    def __missing__(self, raw: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        word = raw.lower().strip(PUNCTUATION)
        found = _lists(word)
        core = raw.lower().strip("\"#%&(),./:;<=>?[\\]_`{}~")
        odd = not core.isalpha() and any(map(str.isalpha, core))
        inner = odd and any(not c.isalpha() for c in core[1:-1])
        stretched = _stretched(word)
        if not found and (inner or stretched or odd):
            for form in (core, core.rstrip("!|+$@"), word):
                hit = _lists(_plain(form)) & (INSULT | PROFANITY)
                if not hit and stretched:
                    single = _single(_plain(form))
                    hit = sum(kind for kind, forms in SINGLE.items() if single in forms)
                if hit:
                    found |= hit | HIDDEN
                    break
        if inner:
            found |= DISGUISED
        if stretched:
            found |= STRETCHED
        if len(word) > 2 and word.isalpha() and raw.isupper():
            found |= SHOUTED
        weight = max([self.learnt.get(term, 0.0) for term in terms_of(word)], default=0.0) if self.learnt else 0.0
        found |= int(min(weight, 15.0) * 8) << 8
        self[raw] = found
        return found


CAPITALS = bytes(range(65, 91))
MARKS = PUNCTUATION.encode()


def features_of(kinds: WordKinds, text: str | None) -> list[float]:
    data = (text or "").encode()
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    known = np.fromiter(map(kinds.__getitem__, tokens), np.uint16, n)
    bits, weights = known & np.uint16(255), (known >> np.uint16(8)) / 8.0
    hits = bits & (INSULT | PROFANITY) > 0
    person = bits & PERSON > 0
    near = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(person)
    np.add.at(near, np.maximum(at - NEAR_WORDS, 0), 1)
    np.add.at(near, np.minimum(at + NEAR_WORDS + 1, n), -1)
    near_hits = int((hits & (np.cumsum(near)[:n] > 0)).sum())
    run = np.concatenate([[0], np.cumsum(hits)])
    window = min(n, 50)
    count = lambda bit: int((bits & bit > 0).sum())
    insults, profane, hidden = count(INSULT), count(PROFANITY), count(HIDDEN)
    size = len(data)
    return [
        float(np.log1p(n)), insults / n, float(np.log1p(insults)), profane / n, float(np.log1p(profane)), count(HOSTILITY) / n,
        hidden / n, float(np.log1p(hidden)), count(PERSON) / n, float(np.log1p(near_hits)), near_hits / n,
        float((run[window:] - run[: n + 1 - window]).max()) / window, (size - len(data.translate(None, CAPITALS))) / size,
        count(SHOUTED) / n, data.count(b"!") / size, (size - len(data.translate(None, MARKS))) / size, count(DISGUISED) / n,
        count(STRETCHED) / n, float(np.log1p((weights > 0).sum())), float((weights > 0).mean()), float(weights.mean()),
        float(weights.max()),
    ]


def features(docs: DataFrame, learnt: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) of every row; an empty or null text has zeros only."""
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float64()))])

    def make():
        kinds = WordKinds(learnt)
        return lambda doc_id, text: (doc_id, features_of(kinds, text))

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(per_row(make, schema), "doc_id bigint, features array<double>")


def held_out(doc_id: Column) -> Column:
    """Rows of which no label may be learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_sample(labels: DataFrame, label_col: str, rows: int) -> DataFrame:
    """(doc_id, label, fold) of labelled rows that are not held out; about ``rows`` of them, by a hash of the id, if there are more.

    An id that is labelled twice counts as toxic if one of its labels says so. Folds 0 and 1 are for the learnt list, 2
    and 3 for the trees, 4 for the calibration.
    """
    label = labels.filter(f"doc_id IS NOT NULL AND {label_col} IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.col(label_col).cast("double")).alias("label")
    )
    label = stage(label.filter(~held_out(F.col("doc_id"))), "labels")
    n = label.count()
    if n > rows:
        label = label.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < 1_000_000 * rows // n)
    return label.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int"))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): documents with the term, counted per batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(*(c.to_pylist() for c in batch.columns)):
            plain = {raw.lower().strip(PUNCTUATION) for raw in (text or "").split()}
            for term in {term for word in plain for term in terms_of(word)}:
                counts.setdefault(term, [0, 0])[label <= 0] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))],
            names=["term", "toxic", "clean"],
        )


def learnt_terms(texts: DataFrame) -> dict[str, float]:
    """Words and beginnings that toxic texts (text, label) have far more often, with the logarithm of the ratio.

    At most ``LEARNT_TERMS`` of them come to the driver: those that most toxic documents have. Equal texts count once.
    """
    texts = texts.dropDuplicates(["text", "label"])
    total = texts.agg(F.count_if(F.col("label") > 0).alias("toxic"), F.count_if(F.col("label") <= 0).alias("clean")).first()
    counts = texts.mapInArrow(_term_counts, "term string, toxic bigint, clean bigint").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    ratio = share("toxic", total["toxic"]) / share("clean", total["clean"])
    found = counts.filter(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    rows = found.orderBy(F.desc("toxic"), F.desc("ratio"), "term").limit(LEARNT_TERMS).select("term", F.ln("ratio").alias("weight")).collect()
    return {r["term"]: r["weight"] for r in rows}


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    training_rows: int = TRAINING_ROWS, limit: float = LIMIT, trees: int = 20, depth: int = 3,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    ``score`` is the calibrated probability; equal calibrated values keep the order of the trees' own.
    Labels (doc_id, ``label_col``) are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1, and of
    those from about ``training_rows`` at most: two fifths for the learnt list, two for the trees, one for the
    calibration. Without rows of both classes for trees and calibration every score is the share of toxic labels,
    or 0 without labels.

    Null and empty texts have zero features and are scored as such; a null id is not held out. Repeated rows give
    repeated results; other columns of both tables are not read.
    """
    sample = stage(training_sample(labels, label_col, training_rows), "sample")
    # The sample has a bounded number of rows of three numbers.
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(sample.filter("fold < 2")), "doc_id"
    )
    with small_batches(docs.sparkSession):
        learnt = learnt_terms(texts.select("text", "label"))
        measured = stage(features(docs, learnt, id_col, text_col), "features")
    rows = stage(measured.join(F.broadcast(sample.filter("fold >= 2")), "doc_id").coalesce(4), "training")
    parts = rows.select(array_to_vector("features").alias("vector"), "label", (F.col("fold") == 4).alias("calibrates"))
    seen = {(r["calibrates"], r["label"]): r["count"] for r in parts.groupBy("calibrates", "label").count().collect()}
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    if len(seen) < 4:
        share = sum(n for (_, label), n in seen.items() if label > 0) / max(sum(seen.values()), 1)
        return measured.select("doc_id", out, F.lit(float(share)).alias("score"), F.lit(int(share >= limit)).alias("predicted"))
    model = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=1,
    ).fit(parts.filter("NOT calibrates"))
    raw = vector_to_array("probability")[1]
    calibration = model.transform(parts.filter("calibrates")).select(raw.alias("raw"), "label")
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(calibration)
    scored = model.transform(measured.select("doc_id", array_to_vector("features").alias("vector"))).select("doc_id", raw.alias("raw"))
    score = F.least(F.greatest(0.999 * F.col("calibrated") + 0.001 * F.col("raw"), F.lit(0.0)), F.lit(1.0))
    return isotonic.transform(scored).select(
        "doc_id", out, score.alias("score"), (score >= limit).cast("int").alias("predicted")
    )
