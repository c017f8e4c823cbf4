"""Reading and writing the store of scored runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.leaderboard import latest_rows
from .workspace import names_in, put_new, read_small, remove

SCORES = "f1 DOUBLE, precision DOUBLE, recall DOUBLE"
RESULTS = (
    f"model STRING, strategy STRING, metrics STRUCT<{SCORES}, exact_match DOUBLE, n BIGINT>, "
    f"per_class MAP<STRING, STRUCT<{SCORES}, n BIGINT>>"
)
STORE_ORDER = "store_ord"
COMMITS, ROWS = "commits", "rows"


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """A results document (one JSON array), one row per run, ``store_ord`` in document order."""
    document = spark.read.text(path, wholetext=True)
    runs = F.from_json("value", f"ARRAY<STRUCT<{RESULTS}>>", {"mode": "FAILFAST", "allowSingleQuotes": "false"})
    rows = document.select(F.posexplode(runs).alias(STORE_ORDER, "run"))
    return rows.select("run.*", F.col(STORE_ORDER).cast("bigint"))


def write_results_json(results: DataFrame, path: str) -> None:
    """Export the store as one JSON array in store order.

    The document is a single value with one entry per run, and is made in one task; the store itself is
    :func:`write_store`.
    """
    entry = F.struct(STORE_ORDER, "model", "strategy", "metrics", "per_class")
    by_order = F.array_sort(F.collect_list(entry), lambda a, b: F.signum(a[STORE_ORDER] - b[STORE_ORDER]).cast("int"))
    document = F.transform(by_order, lambda r: r.dropFields(STORE_ORDER))
    results.agg(F.to_json(document).alias("value")).write.text(path)


def overall_rows(results: DataFrame) -> DataFrame:
    """One flat row per run."""
    return results.select("model", "strategy", "metrics.*", STORE_ORDER)


def class_rows(results: DataFrame) -> DataFrame:
    """One flat row per run and label."""
    return results.select(
        "model", "strategy", STORE_ORDER, F.explode("per_class").alias("label", "score")
    ).select("model", "strategy", STORE_ORDER, "label", "score.*")


class StoreConflict(RuntimeError):
    """Another writer has changed the store since this one looked at it."""


def _commits(spark: SparkSession, path: str) -> list[str]:
    return [n for n in names_in(spark, f"{path}/{COMMITS}") if n.isdigit()]


def _folder(spark: SparkSession, path: str, commit: str) -> str:
    return read_small(spark, f"{path}/{COMMITS}/{commit}")


def _commit(spark: SparkSession, rows: DataFrame, path: str, commits: list[str]) -> None:
    """Write all rows aside, then point to them; ``commits`` is what the writer found before it read anything."""
    number = int(commits[-1]) + 1 if commits else 0
    before = _folder(spark, path, commits[-1]) if commits else None
    # Whatever is not in use by now belongs to writers that failed, or that are refused below or were before.
    unused = [n for n in names_in(spark, f"{path}/{ROWS}") if n != before]
    folder = uuid.uuid4().hex
    rows.hint("rebalance").write.parquet(f"{path}/{ROWS}/{folder}")
    name = f"{number:012d}"
    first = put_new(spark, f"{path}/{COMMITS}/{name}", folder)
    if not first or _commits(spark, path)[-1] != name:  # a name that was free may be one that later writers have removed
        remove(spark, f"{path}/{ROWS}/{folder}")
        if first:
            remove(spark, f"{path}/{COMMITS}/{name}")
        raise StoreConflict(f"{path} has been changed by another writer")
    for name in unused:
        remove(spark, f"{path}/{ROWS}/{name}")
    for old in commits[:-1]:
        remove(spark, f"{path}/{COMMITS}/{old}")


def write_store(results: DataFrame, path: str) -> None:
    """Create a store; one that is there already is an error."""
    spark = results.sparkSession
    if _commits(spark, path):
        raise StoreConflict(f"{path} holds a store")
    _commit(spark, results, path, [])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the last commit: those of a call to :func:`upsert_store` are all there or none is.

    A frame stays readable while one more commit is made; the rows of the one before that are removed.
    """
    commits = _commits(spark, path)
    if not commits:
        raise FileNotFoundError(f"no results store at {path}")
    fields = f"metrics STRUCT<{SCORES}, exact_match DOUBLE, n BIGINT>, per_class MAP<STRING, STRUCT<{SCORES}, n BIGINT>>"
    rows = spark.read.schema(f"{fields}, {STORE_ORDER} BIGINT, model STRING, strategy STRING")
    return rows.parquet(f"{path}/{ROWS}/{_folder(spark, path, commits[-1])}")


def upsert_store(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Replace or add runs; a store that is not there yet is created.

    Of several rows of one run the last one counts. The store is written anew, one row per run, into a folder of its own, and becomes
    the store by one file that names the folder: a write that fails, or is killed, leaves the old store. Of two writers that start
    from one state the second raises :class:`StoreConflict` and may try again. This needs a file system whose rename refuses a target that
    exists (HDFS, local disks).
    """
    commits = _commits(spark, path)
    rows, last = latest_rows(new), -1
    if commits:
        old = read_store(spark, path)
        last = old.agg(F.coalesce(F.max(STORE_ORDER), F.lit(-1))).first()[0]
        kept = old.join(rows.select("model", "strategy"), ["model", "strategy"], "left_anti")
    rows = rows.withColumn(STORE_ORDER, F.lit(last + 1).cast("bigint") + F.col(STORE_ORDER))
    _commit(spark, kept.unionByName(rows) if commits else rows, path, commits)


def _leaves(results: DataFrame) -> DataFrame:
    """(model, strategy, path, value): every number of a run, the per-class ones by label."""
    metric = [F.struct(F.lit(f"metrics.{f}").alias("path"), F.col(f"metrics.{f}").cast("double").alias("value"))
              for f in results.schema["metrics"].dataType.names]
    fields = results.schema["per_class"].dataType.valueType.names
    entries = F.flatten(F.transform(F.map_entries("per_class"), lambda e: F.array(*[
        F.struct(F.concat(F.lit("per_class."), e["key"], F.lit(f".{f}")).alias("path"), e["value"][f].cast("double").alias("value")) for f in fields
    ])))
    whole = F.concat(F.array(*metric), F.coalesce(entries, F.array().cast("array<struct<path: string, value: double>>")))
    return results.select("model", "strategy", F.inline(whole))


def store_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(model, strategy, status, path, before, after) of two stores.

    ``status`` is added, removed, equal or changed. A changed run has a row per number that differs or that only one
    side has; other runs have one row. Runs are paired by a hash of all that they hold, so only the hashes are shuffled for all runs, and
    only the numbers of changed runs are compared one by one. The place in the store is not compared. Two runs of one key are an error of the store.
    """
    content = F.xxhash64("metrics", F.array_sort(F.map_entries("per_class")))
    old, new = (side.select("model", "strategy", content.alias(f"{name}_hash")) for side, name in ((before, "old"), (after, "new")))
    status = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "equal").otherwise("changed")
    )
    paired = old.join(new, ["model", "strategy"], "full_outer").select("model", "strategy", status.alias("status"))
    changed = paired.filter("status = 'changed'").select("model", "strategy")
    sides = [_leaves(side.join(changed, ["model", "strategy"], "left_semi")).withColumnRenamed("value", name)
             for side, name in ((before, "before"), (after, "after"))]
    numbers = sides[0].join(sides[1], ["model", "strategy", "path"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    whole = paired.filter("status <> 'changed'").select(
        "model", "strategy", "status", *[F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("before", "double"), ("after", "double"))]
    )
    return whole.unionByName(numbers.withColumn("status", F.lit("changed")))
