"""Log files of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "value STRING, run_id STRING"


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines of many runs, one folder ``run_id=...`` per run."""
    return spark.read.schema(LINES).text(path)


def follow_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """The same folders as a stream."""
    return spark.readStream.schema(LINES).text(path)


def write_run_logs(lines: DataFrame, path: str) -> None:
    """One folder per run; a run's lines are first brought together, those of a large run in several parts."""
    lines.hint("rebalance", "run_id").write.partitionBy("run_id").text(path)


def list_artifacts(spark: SparkSession, base: str, files: str = "*") -> DataFrame:
    """(slug, prefix, n_files, n_bytes, modified) of every folder of files below ``base``, read from the storage itself.

    Only names, sizes and times of files are read, never their content. ``prefix`` is relative to ``base`` and ends with a slash, ``slug`` is its
    first folder. Files right under ``base`` belong to no artifact. ``files`` is a pattern that a file's name has to match.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files).load(base)
    root = base.split("://")[-1].split(":", 1)[-1] if base.startswith("file:") else base
    inside = F.substring_index("path", f"{root.rstrip('/')}/", -1)
    listed = found.select(inside.alias("file"), "length", "modificationTime")
    prefix = F.regexp_extract("file", r"^(.+/)[^/]+$", 1)
    return listed.withColumn("prefix", prefix).filter("prefix <> ''").groupBy(F.split_part("prefix", F.lit("/"), F.lit(1)).alias("slug"), "prefix").agg(
        F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.max("modificationTime").alias("modified")
    )
