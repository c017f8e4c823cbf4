"""Helpers shared by the operators: tables, words, shingle hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import scratch, stage

__all__ = ["WordHashes", "in_slots", "per_row", "scratch", "shingles", "slots_of", "small_batches", "stage", "table", "words"]

CACHED_WORDS = 20_000
#: Bits of a hash that tell slots apart: 33 million slots, in at most 524,288 rows of 64 slots.
SLOT_BITS = 25
ROWS_IN_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
MIX = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For jobs that run inside: fewer rows at a time go to Python, as texts are long. The session's setting comes back after."""
    before = spark.conf.get(ROWS_IN_BATCH)
    spark.conf.set(ROWS_IN_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_IN_BATCH, before)


def _slot(hashed: Column) -> tuple[Column, Column]:
    slot = F.pmod(hashed, F.lit(1 << SLOT_BITS))
    return F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))


def slots_of(rows: DataFrame, hashed: Column) -> DataFrame:
    """(__slots, __bits): the slots that the hashes of the rows fall into, in a table of bounded size however many rows there are."""
    place, bit = _slot(hashed)
    return rows.select(place.alias("__slots"), bit.alias("__bit")).groupBy("__slots").agg(F.bit_or("__bit").alias("__bits"))


def in_slots(rows: DataFrame, hashed: str, slots: DataFrame) -> DataFrame:
    """The rows with a column ``__hit``: false only if the column ``hashed`` equals none of the hashes that ``slots`` is made of.

    It tells which rows have to take part in a join, so that most of the others stay where they are.
    """
    place, bit = _slot(F.col(hashed))
    marked = rows.withColumn("__slots", place).join(F.broadcast(slots), "__slots", "left")  # at most 2**(SLOT_BITS - 6) rows
    return marked.withColumn("__hit", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__slots", "__bits")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Bytes know no other white space or capitals than these."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * SPREAD
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words, in text order; fewer words are one run."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    runs = hashes[: n - width + 1]
    for k in range(1, width):
        runs = mixed(runs) + hashes[k : n - width + 1 + k]
    return mixed(runs + np.uint64(width))


def per_row(make: Callable[[], Callable[..., tuple]], schema: pa.Schema, rows: int = 200) -> Callable:
    """A function for ``mapInArrow``: ``make`` is called once per task and returns a function of one row's values.

    Rows go out in batches of a bounded number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_row = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = [of_row(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
                )
        pa.default_memory_pool().release_unused()

    return run
