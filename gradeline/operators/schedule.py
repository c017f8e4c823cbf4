"""Class-balanced generation schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import SIGNALLING
from .sequence import dense_ordinals


def scheduled_label(position: Column, labels: tuple[str, ...] = SIGNALLING.labels) -> Column:
    """Label of a schedule position: labels take turns, so that counts differ by one at most."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (position % len(labels) + 1).cast("int"))


def balanced_schedule(spark: SparkSession, n: int, labels: tuple[str, ...] = SIGNALLING.labels) -> DataFrame:
    """n positions with their labels; nothing but the range itself is computed."""
    return spark.range(n).select(F.col("id").alias("pos"), scheduled_label(F.col("id"), labels).alias("label"))


def shuffle_key(seed: int, key: Column) -> Column:
    """Sort key of a reproducible shuffle: the same for a seed and row on every cluster."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_shuffle(df: DataFrame, seed: int, key: str, name: str = "place") -> DataFrame:
    """Give every row its place in a shuffle that depends on nothing but the seed and the key."""
    return dense_ordinals(df.withColumn("_shuffle", shuffle_key(seed, F.col(key))), ["_shuffle", key], name=name).drop(
        "_shuffle"
    )
