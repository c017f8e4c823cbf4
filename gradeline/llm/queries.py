"""The registered queries of this package, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ball_search, byte_bpe, compression, fingerprints, html_extract, minhash_dedup, mixing, oracles, pii, sharding, simhash_dedup, spelling, toxicity, warc
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), max_repetition=2.0)


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_quality(table(spark, sf_dir, "documents"))


def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=24)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_simhash_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_temperature_mixing,
        op3_compression_quality,
        op4_minimax_sharding,
        op5_personal_data,
        op6_toxicity,
        op7_bottom_k_fingerprints,
        op8_html_main_text,
        op9_warc_chunks,
        op10_byte_level_bpe,
        op11_ball_tree_search,
        op12_simhash_bit_sliced,
        op13_spelling_variants,
    )
}
#: Zstandard, CRC-32, trained trees, sketches, element trees and byte-pair merges are beyond SQL; tests/llm has brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op2_temperature_mixing": oracles.mixture(2.0),
    "op5_personal_data": oracles.personal_data(),
    "op9_warc_chunks": oracles.ARCHIVES,
    "op11_ball_tree_search": oracles.SEARCH,
    "op13_spelling_variants": oracles.SPELLING,
}
