"""From raw answers to canonical labels.

Every step is a column that the next one refers to. The planner makes them stacked
projections and keeps one apart when its result is used several times, so each regex
runs once per row, and later steps are evaluated only for rows that reach them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold_for_words, mentions, sql_text, strip
from .vocab import SIGNALLING, Vocabulary


NO_STRINGS = "cast(array() AS array<string>)"


def string_list(values) -> Column:
    """A constant list of strings."""
    items = ", ".join(sql_text(v) for v in values)
    return F.expr(f"array({items})" if items else NO_STRINGS)


def keep_labels(codes: Column, vocab: Vocabulary = SIGNALLING) -> Column:
    """Codes that are labels, canonical, each once, in order of appearance; noise and unknown codes go."""
    if vocab.noise_hides_labels:
        codes = F.filter(codes, lambda c: ~F.upper(strip(c)).isin(*vocab.noise))
    return F.array_intersect(F.transform(codes, lambda c: F.lower(strip(c))), string_list(vocab.labels))


def filter_noise(codes: Column, vocab: Vocabulary = SIGNALLING) -> Column:
    """``keep_labels``, or the default label when nothing is left."""
    return F.coalesce(F.nullif(keep_labels(codes, vocab), string_list([])), string_list([vocab.default]))


def primary_label(codes: Column, vocab: Vocabulary = SIGNALLING) -> Column:
    """The first label after noise filtering."""
    return F.element_at(filter_noise(codes, vocab), 1)


def _answer_steps(text: str, out: str) -> list[Column]:
    """Projections that build the answer without reasoning blocks; each uses the one before."""
    whole, first, second = F.col(text), F.col(f"{out}_1"), F.col(f"{out}_2")
    mark = F.lit("<think>")
    # A block that is never closed runs to the end of the text, so every character is read once.
    blocks = strip(F.regexp_replace(whole, r"(?s)<think>.*?(?:</think>|\z)", ""))
    # Taking a block out can join its surroundings to a new mark.
    cut = strip(F.regexp_replace(first, r"(?s)<think>.*", ""))
    return [
        F.when(F.contains(whole, mark), blocks).otherwise(strip(whole)).alias(f"{out}_1"),
        F.when(F.contains(first, mark), cut).otherwise(first).alias(f"{out}_2"),
        F.when(second == "", whole).otherwise(second).alias(out),
    ]


def with_answer_text(df: DataFrame, text: str = "output", out: str = "answer") -> DataFrame:
    """Add the answer without reasoning blocks; the whole text again if nothing else remains."""
    return df.select("*", *_answer_steps(text, out)).drop(f"{out}_1", f"{out}_2")


def bracketed(answer: Column) -> Column:
    """The first ``[...]`` of the answer, up to its first closing bracket, or null."""
    start = F.instr(answer, "[")
    end = F.call_function("locate", F.lit("]"), answer, start)
    return F.when((start > 0) & (end > 0), F.substring(answer, start, end - start + 1))


def string_items(json_array: Column, vocab: Vocabulary) -> Column:
    """String items of a JSON array; null when the text is not valid JSON."""
    options = {"allowSingleQuotes": "false"}
    if not vocab.labels_look_like_json_scalars:
        # Numbers and literals come out as their spelling, which no label can equal.
        return F.from_json(json_array, "array<string>", options)
    items = F.from_json(json_array, "array<variant>", options)
    texts = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")))
    return texts


def _json_steps(answer: str, vocab: Vocabulary, out: str) -> list[Column]:
    raw, items, kept = (F.col(f"{out}_{n}") for n in ("raw", "items", "kept"))
    spelled = F.concat_ws(" ", F.lower(raw), F.lower(F.array_join(items, " ")))
    is_answer = (kept != string_list([vocab.default])) | F.contains(spelled, F.lit(vocab.default))
    return [
        bracketed(F.col(answer)).alias(f"{out}_raw"),
        string_items(raw, vocab).alias(f"{out}_items"),
        filter_noise(items, vocab).alias(f"{out}_kept"),
        F.when(items.isNotNull() & is_answer, kept).alias(out),
    ]


def with_json_labels(
    df: DataFrame, answer: str = "answer", vocab: Vocabulary = SIGNALLING, out: str = "json_labels"
) -> DataFrame:
    """Labels of the first bracketed JSON list, or null when this step does not decide."""
    return df.select("*", *_json_steps(answer, vocab, out)).drop(f"{out}_raw", f"{out}_items", f"{out}_kept")


@lru_cache
def _named_sql(lowered: str, vocab: Vocabulary) -> str:
    usable = [x for x in vocab.labels if vocab.usable(x)]
    found = [f"CASE WHEN contains({lowered}, {sql_text(x)}) THEN {sql_text(x)} END" for x in usable]
    return f"array_except(array({', '.join(found)}), array(cast(NULL AS string)))" if found else NO_STRINGS


@lru_cache
def _phrased_sql(text: str, folded: str, vocab: Vocabulary) -> str:
    found = []
    for label, patterns in vocab.synonym_groups():
        canonical = vocab.usable(label)
        if canonical is not None and canonical != vocab.default:
            hit = " OR ".join(mentions(text, folded, p) for p in patterns)
            found.append(f"CASE WHEN {hit} THEN {sql_text(canonical)} END")
    # array_compact keeps this large expression out of whole-stage code, where it would make a method
    # beyond the size that the JVM compiles (measured: a third of the time).
    return f"array_distinct(array_compact(array({', '.join(found)})))" if found else NO_STRINGS


def named_labels(lowered: str, vocab: Vocabulary = SIGNALLING) -> Column:
    """Labels spelled out in a lower-cased text column, in the declared order of the vocabulary."""
    return F.expr(_named_sql(lowered, vocab))


def synonym_labels(text: str, folded: str, vocab: Vocabulary = SIGNALLING) -> Column:
    """Labels whose phrases occur in a text column, in table order, without the default label.

    ``folded`` is the column :func:`fold_for_words` makes of the lower-cased text.
    """
    return F.expr(_phrased_sql(text, folded, vocab))


def extract_labels(
    df: DataFrame,
    text: str = "output",
    vocab: Vocabulary = SIGNALLING,
    out: str = "root_cause",
    decided_by: str | None = None,
) -> DataFrame:
    """Add the labels of a raw answer: JSON list, else named labels, else phrases, else the default.

    ``decided_by`` names an optional column that tells which step decided. A null
    text stays null, which lets a caller skip rows at no cost.
    """
    names = ("answer", "json", "lower", "named", "folded", "phrased")
    answer, json, lower, named, folded, phrased = (f"_gl_{n}" for n in names)
    default, missing = string_list([vocab.default]), F.col(text).isNull()
    by_json = F.col(json).isNotNull()
    by_name = (F.size(named) > 0) & (F.col(named) != default)
    by_phrase = F.size(phrased) > 0
    open_text = ~by_json & ~by_name
    steps = df.select(
        "*",
        *_answer_steps(text, answer),
        *_json_steps(answer, vocab, json),
        F.when(~by_json, F.lower(answer)).alias(lower),
        F.when(~by_json, named_labels(lower, vocab)).alias(named),
        F.when(open_text, fold_for_words(F.col(lower))).alias(folded),
        F.when(open_text, synonym_labels(answer, folded, vocab)).alias(phrased),
    )

    def first_decided(by_json_: Column, by_name_: Column, by_phrase_: Column, otherwise: Column) -> Column:
        decided = F.when(missing, F.lit(None)).when(by_json, by_json_).when(by_name, by_name_)
        return decided.when(by_phrase, by_phrase_).otherwise(otherwise)

    results = {out: first_decided(F.col(json), F.col(named), F.col(phrased), default)}
    if decided_by:
        results[decided_by] = first_decided(*[F.lit(n) for n in ("json", "named", "phrase", "default")])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in results]
    return steps.select(*kept, *[column.alias(name) for name, column in results.items()])


def choose_prediction(
    df: DataFrame,
    stored: str = "root_cause",
    text: str = "output",
    vocab: Vocabulary = SIGNALLING,
    out: str = "predicted",
    reextract: bool = False,
) -> DataFrame:
    """Stored labels where there are any, else labels extracted from the raw text.

    ``reextract`` ignores stored labels wherever a raw text exists, so that a
    changed vocabulary takes effect on old predictions.
    """
    has_stored = F.coalesce(F.size(stored) > 0, F.lit(False))
    if reextract:
        has_stored = has_stored & (F.coalesce(F.col(text), F.lit("")) == "")
    raw = F.when(~has_stored, F.coalesce(F.col(text), F.lit("")))
    extracted = extract_labels(df.withColumn("_raw", raw), "_raw", vocab, "_extracted")
    chosen = F.when(F.col("_raw").isNull(), F.col(stored)).otherwise(F.col("_extracted"))
    return extracted.withColumn(out, chosen).drop("_raw", "_extracted")
