"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a document's shingles. Sketches of parts merge into the
sketch of the whole, and two sketches estimate the resemblance and the containment of their shingle sets.
A sketch with fewer than k values is the whole set, and its estimates are exact.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, per_row, shingles, words

SKETCH = 128
WIDTH = 5
BITS = 48
BYTES = BITS // 8


def sketch(hashes: WordHashes, text: str | None, width: int = WIDTH, k: int = SKETCH) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    return smallest(shingles(hashes.of(words(text)), width) >> np.uint64(64 - BITS), k)


def smallest(values: np.ndarray, k: int) -> np.ndarray:
    few = 4 * k
    if len(values) > few:
        # Repeated values may fill the first places; then the whole is needed.
        part = np.unique(np.partition(values, few)[:few])
        if len(part) >= k:
            return part[:k]
    return np.unique(values)[:k]


def merge(parts: list[np.ndarray], k: int = SKETCH) -> np.ndarray:
    """The sketch of all the parts together."""
    return smallest(np.concatenate(parts), k) if parts else np.zeros(0, np.uint64)


def distinct_shingles(a: np.ndarray, k: int = SKETCH) -> float:
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / float(a[-1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Estimate of shared over all shingles; two empty documents resemble each other fully, one and none not at all."""
    if not len(a) and not len(b):
        return 1.0
    union = merge([a, b], k)
    return float(np.isin(np.intersect1d(a, b, True), union, True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Estimate of the share of a's shingles that b has too; an empty document is contained in all."""
    if not len(a):
        return 1.0
    if not len(b):
        return 0.0
    top = min(a[-1] if len(a) >= k else 2**BITS, b[-1] if len(b) >= k else 2**BITS)
    below = a[a <= top]
    return float(np.isin(below, b).mean()) if len(below) else 0.0


def to_text(a: np.ndarray) -> str:
    """Base64 of the values, six big-endian bytes each; equal sketches have equal texts."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()).decode()


def from_text(text: str | None) -> np.ndarray:
    data = np.frombuffer(base64.b64decode(text or ""), np.uint8).reshape(-1, BYTES)
    whole = np.zeros((len(data), 8), np.uint8)
    whole[:, 8 - BYTES :] = data
    return whole.reshape(-1).view(">u8").astype(np.uint64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = SKETCH) -> DataFrame:
    """(doc_id, sketch, distinct_shingles) of every row; a null text has an empty sketch. Null ids stay, other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("sketch", pa.string()), ("distinct_shingles", pa.float64())])

    def make():
        hashes = WordHashes()

        def of_row(doc_id, text):
            found = sketch(hashes, text, width, k)
            return doc_id, to_text(found), distinct_shingles(found, k)

        return of_row

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(per_row(make, schema), "doc_id bigint, sketch string, distinct_shingles double")


def merge_sketches(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = SKETCH) -> DataFrame:
    """(key, sketch) of all parts with a key.

    Each task first merges what it has read, in runs of a bounded number of keys, so a key with a third of all
    rows sends a few sketches per task. A null sketch is an empty one; null keys are a key.
    """
    kind = parts.schema[key].dataType
    rows = parts.select(F.col(key).alias("key"), F.col(sketch_col).cast("string").alias("sketch"))

    def early(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby("key", dropna=False, sort=False)["sketch"].agg(
                lambda s: to_text(merge([from_text(x) for x in s], k))
            ).reset_index()

    def late(frame: pd.DataFrame) -> pd.DataFrame:
        merged = merge([from_text(x) for x in frame["sketch"]], k)
        return frame.head(1).assign(sketch=to_text(merged))

    schema = f"key {kind.simpleString()}, sketch string"
    return rows.mapInPandas(early, schema).groupBy("key").applyInPandas(late, schema).withColumnRenamed("key", key)


PAIRED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("distinct_shingles", pa.float64()), ("contained_in_edited", pa.float64()),
])
PAIRED_SQL = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
    " near_next double, distinct_shingles double, contained_in_edited double"
)


def _pairs(width: int, k: int):
    """Rows come in order; the first row beyond the range only serves as the next of the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held = None
        for batch in batches:
            out = []
            for beyond, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("beyond", "doc_id", "text"))):
                if held is not None and held[3]:
                    break
                here = (doc_id, text, sketch(hashes, text, width, k), beyond)
                if held is not None:
                    out.append(_paired(hashes, held, here, width, k))
                held = here
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIRED)], schema=PAIRED)

    return run


def _paired(hashes: WordHashes, here: tuple, following: tuple, width: int, k: int) -> tuple:
    doc_id, text, own, _ = here
    half = len(text) // 2
    edited = text[: len(text) - half] + following[1][:half]
    changed = sketch(hashes, edited, width, k)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(own), to_text(changed),
        resemblance(own, changed, k), resemblance(own, following[2], k), distinct_shingles(own, k), containment(own, changed, k),
    )


def compare_with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = SKETCH, ranges: int | None = None
) -> DataFrame:
    """Fingerprints of every document and of its edited text, and what they say about both and the next document.

    The edited text has its last half replaced by the beginning of the next document by ascending id;
    the first follows the last. The ids alone are sorted first, for the lowest id of each range. Then each
    text goes once to the task of its range, and the first of a range also to the range before, so every task has all neighbours and walks through its range in order, holding two texts.

    A null text is an empty one. Null ids come before all others; rows with equal ids follow each other by text. An
    empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)).cast("bigint"))
    lowest = (
        docs.select(order.alias("at")).repartitionByRange(n, "at").groupBy(F.spark_partition_id().alias("range"))
        .agg(F.min("at").alias("at")).select("at").collect()  # one number per range
    )
    bounds = sorted(row["at"] for row in lowest)
    last = max(len(bounds) - 1, 0)

    @F.pandas_udf("array<int>")
    def places(at: pd.Series) -> pd.Series:
        found = []
        for value in at:
            own = max(bisect.bisect_right(bounds, value) - 1, 0)
            found.append([own, own - 1 if own else last] if bounds[own] == value else [own])
        return pd.Series(found, dtype=object)

    rows = docs.select(
        order.alias("at"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("places", places("at"))
    placed = rows.select("at", "doc_id", "text", F.posexplode("places").alias("copy", "range"))
    placed = placed.withColumn("beyond", F.col("copy") == 1).repartitionById(max(len(bounds), 1), F.col("range"))
    ordered = placed.sortWithinPartitions("beyond", "at", "text").select("beyond", "doc_id", "text")
    return ordered.mapInArrow(_pairs(width, k), PAIRED_SQL)
