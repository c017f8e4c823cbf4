"""Documents that operators stumble over, and plain words, for tests of several operators."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def _rows():
    rng = random.Random(9)

    def sentence(n, vocabulary=300):
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    base = sentence(60)
    rows = [(1, base), (2, base), (3, base.upper()), (4, base + " extra"), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "One"),
            (10, "one\x1ctwo\xa0three four"), (11, "é" * 30 + " 語 😀 \x00 tail Éclairs ÉCLAIRS"), (None, base), (None, None),
            (12, sentence(20_000)), (1, base), (2, "another text under a used id"), (13, "ÿ-ß_x1 ×÷ naïve NAÏVE")]
    rows += [(20 + k, sentence(rng.randrange(1, 80))) for k in range(40)] + [(60 + k, base) for k in range(30)]
    return rows


ROWS = _rows()


def awkward_documents(spark, clashes=()):
    """The rows with columns whose names an operator uses itself."""
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(5)
    return frame.withColumns({c: F.lit(-1) for c in clashes})
