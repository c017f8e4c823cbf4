"""Positions, running totals and neighbours in one large ordered sequence.

A window over a whole sequence would put it into one task. Here the rows are
range-partitioned by the order and written once; what has to pass from one range
to the next is a single row per range. Running totals and neighbours are found while a
sorted range is streamed to the table, on Arrow batches of the few columns they need. A sequence that holds a third of all rows
is cut into ranges like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import getcontext
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import stage

SLOT, CHUNK, SCAN = "_slot", "_chunk", "_scan"


def _in_ranges(df: DataFrame, within: list[str], order_by: list[str]) -> DataFrame:
    """The rows in ranges of (within, order_by); ``_slot`` is the position inside the range ``_chunk``."""
    keys = [*within, *order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(ranged.select("*", F.spark_partition_id().alias(CHUNK), F.monotonically_increasing_id().alias(SLOT)), "ranges")


def _join_chunks(rows: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the one row per range; keys may be null."""
    renamed = chunks.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys])
    return rows.join(renamed, match).drop(*[f"_key_{k}" for k in keys])


def dense_ordinals(
    df: DataFrame, order_by: list[str], within: Sequence[str] = (), name: str = "ord", total: str | None = None
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in order; ``total`` also adds the length of the sequence.

    ``order_by`` must tell all rows of a sequence apart.
    """
    within = list(within)
    rows = _in_ranges(df, within, list(order_by))
    keys = [*within, CHUNK]
    sizes = rows.groupBy(*keys).agg(F.min(SLOT).alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*within).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    chunks = sizes.select(
        *keys, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*within)).alias("_total"),
    )
    numbered = _join_chunks(rows, stage(chunks, "offsets"), keys)
    numbered = numbered.withColumn(name, F.col("_before") + F.col(SLOT) - F.col("_first"))
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop(SLOT, CHUNK, "_first", "_before", "_total")


def file_ordinals(lines: DataFrame, within: Sequence[str] = (), name: str = "ord", total: str | None = None) -> DataFrame:
    """Number lines 0, 1, 2, ... in file order; nothing is sorted or moved.

    ``lines`` comes from :func:`..sources.jsonl.read_lines_in_order`, written once: the lines of a block already lie in order,
    so all that is needed is how many lines the blocks before it hold. There is one row per block of a file; its size
    decides how the join runs.
    """
    keys = [*within, "file", "block"]
    sizes = lines.groupBy(*keys).agg(F.min("line").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.select(
        *keys, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*within)).alias("_total"),
    )
    numbered = _join_chunks(lines, stage(blocks, "offsets"), keys)
    numbered = numbered.withColumn(name, F.col("_before") + F.col("line") - F.col("_first"))
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_first", "_before", "_total")


def _scanner(n_keys: int, n_sums: int):
    """Go once over the sorted rows of a task: running sums and the row before, both anew at every change of the keys.

    Only one row and one sum per column are carried from batch to batch.
    """

    def sums_of(values: np.ndarray, starts: np.ndarray, carry) -> np.ndarray:
        if values.dtype.kind == "i":
            carry = int(carry)
            largest = max(abs(int(values.min())), abs(int(values.max()))) * len(values) + abs(carry)
            if largest < 2**63:
                sums = np.cumsum(values)
                begun = sums[starts] - values[starts]
                begun[0] = -carry
                return sums - np.repeat(begun, np.diff(starts, append=len(values)))
            values = values.astype(object)  # exact; Arrow refuses what does not fit
        sums = np.empty_like(values)
        for lo, hi in zip(starts, [*starts[1:], len(values)]):
            np.cumsum(values[lo:hi], out=sums[lo:hi])
        sums[: starts[1] if len(starts) > 1 else None] += carry
        return sums

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        getcontext().prec = 76  # sums of decimals have up to 38 digits
        last, carries = None, [0] * n_sums
        for batch in batches:
            if not len(batch):
                columns = batch.flatten()
                yield pa.StructArray.from_arrays([pa.array([], pa.bool_()), *columns[n_keys:]], [str(i) for i in range(len(columns) - n_keys + 1)])
                continue
            columns = batch.flatten()
            before = [
                pa.concat_arrays([pa.nulls(1, c.type) if last is None else last[i], c[:-1]]) for i, c in enumerate(columns)
            ]
            same = np.ones(len(batch), dtype=bool)
            for key, earlier in zip(columns[:n_keys], before):
                alike = pc.fill_null(pc.equal(key, earlier), False)
                same &= pc.or_(alike, pc.and_(key.is_null(), earlier.is_null())).to_numpy(zero_copy_only=False)
            if last is None:
                same[0] = False
            starts = np.union1d([0], np.flatnonzero(~same)).astype(int)
            sums = []
            for i, column in enumerate(columns[n_keys : n_keys + n_sums]):
                done = sums_of(column.to_numpy(zero_copy_only=False), starts, carries[i] if same[0] else 0)
                carries[i] = done[-1]
                sums.append(pa.array(done, column.type))
            last = [c[-1:] for c in columns]
            found = [pa.array(~same), *sums, *before[n_keys + n_sums :]]
            yield pa.StructArray.from_arrays(found, [str(i) for i in range(len(found))])

    return scan


def _scanned(df: DataFrame, within: list[str], order_by: list[str], sums: dict[str, Column], previous: dict[str, str]) -> DataFrame:
    """The rows in ranges of (within, order_by), scanned as they leave the sort: one exchange, one pass.

    ``_scan`` has ``start`` (first row of its sequence in the range ``_chunk``), the running ``sums`` inside the range (a null
    adds nothing) and the ``previous`` values inside the range. Only the columns that are named go through Python.
    """
    keys = [*within, *order_by]
    types = [f.dataType for f in df.select(*[F.sum(c) for c in sums.values()]).schema]
    added = [F.coalesce(c.cast(t), F.lit(0).cast(t)) for c, t in zip(sums.values(), types)]
    columns = [*[F.col(k).cast("string") for k in within], *added, *map(F.col, previous.values())]
    kinds = ["boolean", *[t.simpleString() for t in types], *[df.select(c).schema[0].dataType.simpleString() for c in previous.values()]]
    names = ["start", *sums, *previous]
    found = F.arrow_udf(
        _scanner(len(within), len(sums)), f"struct<{','.join(f'`{i}`:{k}' for i, k in enumerate(kinds))}>"
    ).asNondeterministic()(F.struct(*[c.alias(str(i)) for i, c in enumerate(columns)]))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    scanned = ranged.select("*", F.spark_partition_id().alias(CHUNK), found.alias(SCAN))
    return scanned.withColumn(SCAN, F.struct(*[F.col(SCAN)[str(i)].alias(n) for i, n in enumerate(names)]))


def _carried(rows: DataFrame, offsets: DataFrame, within: list[str]) -> DataFrame:
    """Attach what a sequence brings along from earlier ranges.

    Only the first sequence of a range can have begun before it, so ``offsets`` has at most one row per range,
    and there are at most ``spark.sql.shuffle.partitions`` ranges: that is what is handed to all tasks.
    """
    keys = [*within, CHUNK]
    renamed = offsets.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys])
    return rows.join(F.broadcast(renamed), match, "left").drop(*[f"_key_{k}" for k in keys])


def running_totals(
    df: DataFrame, sums: dict[str, str], order_by: list[str], within: Sequence[str] = (), name: str = "ord"
) -> DataFrame:
    """Position of every row and, for each ``{new: column}``, the sum of the column up to and with that row.

    A sum is null before the first value that is not. ``within`` are strings, whole numbers, dates or times. Rows move
    once; what a sequence sums up to in earlier ranges is added to its rows afterwards.
    """
    within = list(within)
    counted = {name: F.lit(1), **{new: F.col(column) for new, column in sums.items()}}
    counted |= {f"_met_{new}": F.when(F.col(column).isNotNull(), 1).otherwise(0) for new, column in sums.items()}
    rows = stage(_scanned(df, within, list(order_by), counted, {}), "ranges")
    sizes = rows.groupBy(*within, CHUNK).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{n}") for n, c in counted.items()])
    in_order = Window.partitionBy(*within).orderBy(CHUNK)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *within, CHUNK, *[F.sum(f"_sum_{n}").over(earlier).alias(f"_sum_{n}") for n in counted], F.lag(CHUNK).over(in_order).alias("_before"),
    ).filter("_before IS NOT NULL").drop("_before")
    joined = _carried(rows, offsets if within else stage(offsets, "offsets"), within)
    totals = {n: F.col(SCAN)[n] + F.coalesce(F.col(f"_sum_{n}"), F.lit(0)) for n in counted}
    found = {name: totals[name] - 1, **{new: F.when(totals[f"_met_{new}"] > 0, totals[new]) for new in sums}}
    return joined.withColumns(found).drop(CHUNK, SCAN, *[f"_sum_{n}" for n in counted])


def previous_values(
    df: DataFrame, previous: dict[str, str], order_by: list[str], within: Sequence[str] = ()
) -> DataFrame:
    """For each ``{new: column}``, the value of the column in the row before; null in the first row.

    ``within`` are strings, whole numbers, dates or times. Rows move once; the first row of a range gets the last
    values of the range before.
    """
    within = list(within)
    rows = stage(_scanned(df, within, list(order_by), {"place": F.lit(1)}, previous), "ranges")
    values = F.struct(*[F.col(c).alias(n) for n, c in previous.items()])
    lasts = rows.groupBy(*within, CHUNK).agg(F.max_by(values, F.col(SCAN)["place"]).alias("_last"))
    in_order = Window.partitionBy(*within).orderBy(CHUNK)
    offsets = lasts.select(*within, CHUNK, F.lag("_last").over(in_order).alias("_carried")).filter("_carried IS NOT NULL")
    joined = _carried(rows, offsets if within else stage(offsets, "offsets"), within)
    scan = F.col(SCAN)
    found = {n: F.when(scan["start"], F.col("_carried")[n]).otherwise(scan[n]) for n in previous}
    return joined.withColumns(found).drop(CHUNK, SCAN, "_carried")


def mini_batches(df: DataFrame, size: int, order_by: list[str], within: Sequence[str] = ()) -> DataFrame:
    """Consecutive batches of ``size`` rows: batch number and position inside the batch."""
    numbered = dense_ordinals(df, order_by, within)
    return numbered.select(
        "*", F.expr(f"ord div {int(size)}").alias("batch"), (F.col("ord") % int(size)).alias("batch_pos")
    )
