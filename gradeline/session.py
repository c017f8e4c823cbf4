"""Session settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .sources.workspace import CHECKPOINT_DIR


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradeline")
        .config("spark.ui.enabled", "false")
        .config(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="gradeline-"))
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # a small file is read by several tasks, as its rows may be multiplied or parsed
        .config("spark.sql.files.minPartitionNum", str(shuffle_partitions))
        .config("spark.sql.files.openCostInBytes", "65536")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
