"""JSON-lines inputs and outputs: labelled examples and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

EXAMPLES = "log STRING, root_cause ARRAY<STRING>"
PREDICTIONS = "root_cause ARRAY<STRING>, output STRING, raw STRING"
CORRUPT = "_corrupt"


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: str, lenient: bool = False, options: dict | None = None
) -> DataFrame:
    """Read a file, folder or glob of JSON lines; blank lines are skipped.

    One bad line stops the read. With ``lenient`` it is kept in ``_corrupt`` instead.
    """
    reader = spark.read.options(allowSingleQuotes="false", **(options or {}))
    if lenient:
        return reader.schema(f"{schema}, {CORRUPT} STRING").json(path, columnNameOfCorruptRecord=CORRUPT)
    return reader.schema(schema).json(path, mode="FAILFAST")


def read_examples(spark: SparkSession, path: str | list[str], extra: str = "", lenient: bool = False) -> DataFrame:
    """Labelled examples; ``extra`` declares further columns such as ``ex_id BIGINT``."""
    return read_jsonl(spark, path, ", ".join(x for x in (extra, EXAMPLES) if x), lenient)


def read_predictions(spark: SparkSession, path: str | list[str], extra: str = "", lenient: bool = False) -> DataFrame:
    """Predictions of hosted models (``raw``) and local models (``output``) in one schema."""
    return read_jsonl(spark, path, ", ".join(x for x in (extra, PREDICTIONS) if x), lenient)


def read_lines_in_order(spark: SparkSession, path: str | list[str], folders: str = "") -> DataFrame:
    """Non-blank lines with columns that sort in file order: ``file``, ``block`` and ``line``.

    ``folders`` declares the columns in folder names, such as ``model STRING``.
    """
    schema = ", ".join(x for x in ("value STRING", folders) if x)
    lines = spark.read.schema(schema).text(path).filter(strip(F.col("value")) != "")
    return lines.select(
        *[c for c in lines.columns if c != "value"],
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def kept_raw(strategy: Column, raw: Column) -> Column:
    """Raw answers are stored only for chain-of-thought strategies."""
    return F.when(F.contains(strategy, F.lit("cot")), raw).otherwise(F.lit(""))


def write_predictions(df: DataFrame, path: str) -> None:
    """One folder per (model, strategy), so that readers of one run touch only its files.

    Rows are first brought together by run, a large run in several parts, so that not every task writes to every folder.
    """
    df.hint("rebalance", "model", "strategy").write.partitionBy("model", "strategy").option("ignoreNullFields", "false").json(path)


def write_examples(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_records(records: DataFrame, path: str, record: str = "record") -> None:
    """Whole JSON records, one per line, with every key and item they came with.

    Line ends inside a JSON record can only stand between its parts, where they mean nothing.
    """
    records.select(F.regexp_replace(record, r"[\r\n]+", " ").alias("value")).write.text(path)


def write_judged(parsed: DataFrame, path: str, text: str = "generated") -> tuple[int, int]:
    """Write valid records and rejected texts in one pass over the records, and count both while they are written.

    ``kind=valid`` has the records as :func:`write_records` writes them, ``kind=quarantined`` a JSON line with the reason and the text for each
    rejected one. Returns (valid, quarantined).
    """
    valid = F.col("reason").isNull()
    seen = Observation()
    rejected = F.to_json(F.struct("reason", F.col(text).alias("text")), {"ignoreNullFields": "false"})
    counted = parsed.observe(seen, F.count_if(valid).alias("valid"), F.count_if(~valid).alias("quarantined"))
    counted.select(
        F.when(valid, F.lit("valid")).otherwise("quarantined").alias("kind"),
        F.when(valid, F.regexp_replace("record", r"[\r\n]+", " ")).otherwise(rejected).alias("value"),
    ).write.partitionBy("kind").text(path)
    return seen.get["valid"], seen.get["quarantined"]


def allow_repeated_keys(spark: SparkSession) -> None:
    """Of a key that comes twice in an object the last value counts, as in most JSON readers; a setting of the session."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: ``log``, the texts of ``root_cause``, and everything as the variant ``record``. Of a repeated key the last value counts."""
    allow_repeated_keys(spark)
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = lines.select(F.parse_json("value").alias("record"))
    items = F.try_variant_get("record", "$.root_cause", "array<variant>")
    texts = F.filter(
        F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))), lambda s: s.isNotNull()
    )
    return parsed.select(F.try_variant_get("record", "$.log", "string").alias("log"), texts.alias("root_cause"), "record")


def rows_per_run(df: DataFrame, run_keys: list[str], expected: DataFrame | Column) -> DataFrame:
    """Rows of every run against the number it should have, given as a table by run or as an expression over its keys."""
    counts = df.groupBy(*run_keys).agg(F.count("*").alias("n_rows"))
    if isinstance(expected, Column):
        counts = counts.withColumn("n_expected", expected.cast("bigint"))
    else:
        counts = counts.join(expected, run_keys, "full_outer").fillna({"n_rows": 0, "n_expected": 0})
    return counts.withColumn("complete", F.col("n_rows") == F.col("n_expected"))
