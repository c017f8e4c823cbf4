"""Documents to token ids: five stages, each of which reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeline.llm import byte_bpe, compression, minhash_dedup, mixing, pii
from gradeline.llm.queries import PATTERN, VOCABULARY
from gradeline.sources.workspace import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression rules reject go."""
    return compression.drop_rejected(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return minhash_dedup.drop_near_duplicates(docs, width=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources come up to twice, the largest once; nothing is left out. Rows lie in the order of block and slot."""
    return mixing.mixed_documents(docs, max_repetition=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded_sha256) of every document of the mixture."""
    return byte_bpe.encode(docs, VOCABULARY, PATTERN)


STAGES = [
    ("quality", quality),
    ("near_dedup", deduplicate),
    ("pii", redact),
    ("mixing", mix),
    ("byte_bpe", encode),
]
#: No SQL: zstandard ratios and byte-pair merges are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, f"pipeline-{name}")
    return docs
