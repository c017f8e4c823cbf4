"""The registered queries: every operator bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..functions.vocab import SIGNALLING, Vocabulary
from ..operators import align, codes, leaderboard, metrics, predict, prompts, runlogs, schedule, sequence, validate
from ..sources import jsonl, results_store
from ..sources import runlogs as logs
from ..sources.workspace import fresh_path, stage
from ..streaming import jobs
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RUN = metrics.RUN
KEY = [*RUN, "ex_id"]
STRATEGIES = ["slm", "zero_shot", "five_shot", "five_shot_cot"]
#: Names under which the runs are looked up as families, by place in the store, and the registered family names.
FAMILY_RUNS = ("a", "a-x", "a-x-y", "b-x", "a-xy", "a-x-y-z")
FAMILIES = ("a", "a-x", "c", "a-x-y-z-0")
MODEL_NAMES = {"m0": "Model Zero", "m1": "Model One", "m2": "Model Two"}
STRATEGY_NAMES = {"slm": "Fine-tuned", "zero_shot": "Zero-shot", "five_shot": "5-shot"}
MODEL_KINDS = {"m0": "local", "m1": "hosted", "m2": "hosted"}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- shared plans -------------------------------------------------------------------------------


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with extracted labels and the step that decided."""
    return L.extract_labels(fx.predictions(spark, sf_dir), out="codes", decided_by="step")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, ex_id, gold, pred): only ids and labels take part in the join."""
    preds = extracted(spark, sf_dir).select(*KEY, F.element_at("codes", 1).alias("pred"))
    return align.align_by_id(fx.gold_labels(spark, sf_dir), preds)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(paired(spark, sf_dir).select(*RUN, "gold", "pred"))


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder with the training logs of all runs."""
    path = fresh_path(spark, "logs")
    logs.write_run_logs(fx.training_lines(spark, sf_dir), path)
    return path


def training_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlogs.parse_training(logs.read_run_logs(spark, log_files(spark, sf_dir)))


def run_order() -> Column:
    order = F.create_map(*[F.lit(x) for r, m, s, _, _ in fx.RUNS for x in (f"{m}/{s}", r)])
    return F.try_element_at(order, F.concat_ws("/", *RUN)).cast("bigint")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run with its place in the store."""
    return metrics.overall(cells(spark, sf_dir)).withColumn("store_ord", run_order())


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class(cells(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_results(cells(spark, sf_dir)).withColumn("store_ord", run_order())


def joined(items: str | Column) -> Column:
    return F.array_join(items, "|")


# --- sources and sinks --------------------------------------------------------------------------


@query
def s1_read_examples(spark, sf_dir):
    """JSON lines with blank lines in between, read strictly."""
    path = fresh_path(spark, "examples")
    record = F.to_json(F.struct("ex_id", "log", "root_cause"))
    blank = F.when(F.col("ex_id") % 4 == 0, "\n \n").otherwise("")
    fx.examples(spark, sf_dir).select(F.concat(record, blank).alias("value")).write.text(path)
    return jsonl.read_examples(spark, path, "ex_id BIGINT").select("ex_id", "log", joined("root_cause").alias("codes"))


@query
def s1_read_examples_lenient(spark, sf_dir):
    """JSON lines of which some are broken: those are kept aside and counted."""
    path = fresh_path(spark, "examples")
    record = F.to_json(F.struct("ex_id", "log", "root_cause"))
    line = F.when(F.col("ex_id") % 7 == 3, F.expr("substring(record, 1, length(record) - 3)")).otherwise(F.col("record"))
    fx.examples(spark, sf_dir).withColumn("record", record).select(line.alias("value")).write.text(path)
    read = jsonl.read_examples(spark, path, "ex_id BIGINT", lenient=True)
    corrupt = F.col(jsonl.CORRUPT).isNotNull()
    return read.groupBy(F.when(~corrupt, F.element_at("root_cause", 1)).alias("label"), corrupt.alias("corrupt")).agg(
        F.count("*").alias("n"), F.sum(F.when(~corrupt, F.length("log"))).alias("n_chars")
    )


@query
def s2_read_predictions(spark, sf_dir):
    """Predictions with and without stored labels in one schema."""
    path = fresh_path(spark, "predictions")
    stored = fx.stored_predictions(spark, sf_dir).select(*KEY, "root_cause", "output")
    stored.write.json(path)
    read = jsonl.read_predictions(spark, path, "model STRING, strategy STRING, ex_id BIGINT")
    return read.select(*KEY, joined("root_cause").alias("codes"), "output", "raw")


@query
def s3_read_training_folder(spark, sf_dir):
    """The same training files through a folder and through a glob."""
    path = fresh_path(spark, "training")
    jsonl.write_examples(fx.examples(spark, sf_dir).select("log", "root_cause"), path)
    read = [jsonl.read_examples(spark, p).withColumn("via", F.lit(v)) for p, v in ((path, "folder"), (f"{path}/*.json", "glob"))]
    return read[0].unionByName(read[1]).groupBy("via", F.element_at("root_cause", 1).alias("label")).agg(
        F.count("*").alias("n"), F.sum(F.length("log")).alias("n_chars")
    )


@query
def s4_read_results(spark, sf_dir):
    """The results document: one JSON array, one row per run and label."""
    path = fresh_path(spark, "results")
    results_store.write_results_json(results(spark, sf_dir), path)
    return results_store.class_rows(results_store.read_results_json(spark, path))


@query
def s5_training_log_lines(spark, sf_dir):
    """Log files as text, reduced to their metric lines."""
    return training_steps(spark, sf_dir).groupBy("run_id", "kind").agg(
        F.count("*").alias("n"), F.max("step").alias("last_step"), F.max("loss").alias("max_loss")
    )


@query
def s6_rows_per_run(spark, sf_dir):
    """Row counts of every run against the size of the gold set, without the examples shown to the model."""
    gold = fx.gold_labels(spark, sf_dir).agg(F.count("*")).scalar()
    return jsonl.rows_per_run(fx.predictions(spark, sf_dir), RUN, gold - align.shots_in(F.col("strategy")))


@query
def s7_latest_artifact(spark, sf_dir):
    """Newest output folder per model among the jobs that did not fail."""
    listing = fx.artifact_listing(spark, sf_dir)
    return runlogs.latest_artifacts(listing, usable=F.col("status") != "F")


@query
def s7_list_storage(spark, sf_dir):
    """The newest output folder per model, from the storage: one folder per model and month, of which some hold no result file."""
    base = fresh_path(spark, "output")
    month = F.date_format("o_orderdate", "yyyy-MM")
    jobs_done = fx.table(spark, sf_dir, "orders").select(
        X.slug(fx.label_at("o_custkey", fx.BASE_MODELS)).alias("slug"), month.alias("job"), F.col("o_orderkey").cast("string").alias("value"),
    )
    done = jobs_done.hint("rebalance", "slug", "job")
    done.filter("right(job, 2) <> '12'").write.partitionBy("slug", "job").text(base)
    done.filter("right(job, 2) = '12'").write.mode("append").partitionBy("slug", "job").option("compression", "gzip").text(base)
    listing = logs.list_artifacts(spark, base, files="*.txt")
    return runlogs.latest_artifacts(listing)


@query
def k1_write_examples(spark, sf_dir):
    """Valid generated records written whole as JSON lines and read back, with all their keys and items."""
    path = fresh_path(spark, "examples")
    valid = validate.valid_records(validate.parse_records(fx.generated_texts(spark, sf_dir)))
    jsonl.write_records(valid, path)
    part = lambda key: F.to_json(F.try_variant_get("record", f"$.{key}", "variant"))
    return jsonl.read_records(spark, path).select(
        "log", joined("root_cause").alias("codes"), part("root_cause").alias("items"), part("extra").alias("extra")
    )


@query
def k2_write_predictions(spark, sf_dir):
    """Predictions by run; the raw answer is kept for chain-of-thought runs only."""
    path = fresh_path(spark, "predictions")
    kept = extracted(spark, sf_dir).select(
        *KEY, F.col("codes").alias("root_cause"), jsonl.kept_raw(F.col("strategy"), F.col("output")).alias("raw")
    )
    jsonl.write_predictions(kept, path)
    read = jsonl.read_predictions(spark, path, "ex_id BIGINT, model STRING, strategy STRING")
    return read.select(*KEY, joined("root_cause").alias("codes"), "raw")


@query
def k3_upsert_store(spark, sf_dir):
    """A store of five runs into which one run is scored again and one is added."""
    path = fresh_path(spark, "store")
    runs = stage(results(spark, sf_dir), "runs")
    results_store.write_store(runs.filter("store_ord < 5"), path)
    again = runs.filter("store_ord IN (1, 5)").withColumn("store_ord", F.when(F.col("store_ord") == 1, 0).otherwise(1))
    results_store.upsert_store(spark, again.withColumn("store_ord", F.col("store_ord").cast("bigint")), path)
    return results_store.overall_rows(results_store.read_store(spark, path))


@query
def k3_first_run(spark, sf_dir):
    """The first runs go into a store that is not there yet."""
    path = fresh_path(spark, "store")
    results_store.upsert_store(spark, results(spark, sf_dir).filter("store_ord IN (2, 4)"), path)
    return results_store.overall_rows(results_store.read_store(spark, path))


@query
def k3_repeated_key(spark, sf_dir):
    """A run that comes twice in one call, and again in a second call: its last row stays."""
    path = fresh_path(spark, "store")
    runs = stage(results(spark, sf_dir), "runs")
    better = F.col("metrics").withField("f1", F.lit(2.0))
    twice = runs.withColumn("metrics", better).unionByName(runs.withColumn("store_ord", F.col("store_ord") + 10))
    results_store.upsert_store(spark, twice, path)
    results_store.upsert_store(spark, runs.filter("store_ord = 3"), path)
    return results_store.overall_rows(results_store.read_store(spark, path))


@query
def k4_read_one_run(spark, sf_dir):
    """One run of partitioned predictions: only its folder is read."""
    path = fresh_path(spark, "predictions")
    jsonl.write_predictions(fx.predictions(spark, sf_dir).select(*KEY, "output"), path)
    read = jsonl.read_predictions(spark, path, "ex_id BIGINT, model STRING, strategy STRING")
    return read.filter("model = 'm1' AND strategy = 'five_shot'").select(*KEY, "output")


@query
def k5_report_summary(spark, sf_dir):
    """The ranked report table."""
    return leaderboard.summary_table(scored(spark, sf_dir), MODEL_NAMES, STRATEGY_NAMES, MODEL_KINDS)


@query
def k5_report_classes(spark, sf_dir):
    """Per-class tables of the best run of every model."""
    best = leaderboard.best_per(scored(spark, sf_dir), "model")
    grid = leaderboard.label_grid(leaderboard.select_runs(classes(spark, sf_dir), best), SIGNALLING.labels)
    shown = [F.coalesce(X.percent(F.col(c)), F.lit("-")).alias(c) for c in ("f1", "precision", "recall")]
    return grid.select(*RUN, "label_ord", "label", *shown, "n", F.coalesce(F.col("f1") == 1.0, F.lit(False)).alias("perfect"))


@query
def s7_required_artifacts(spark, sf_dir):
    """The newest usable output folder of every base model; a model without one would be an error."""
    listing = fx.artifact_listing(spark, sf_dir)
    wanted = listing.select("slug").distinct()
    return runlogs.require_artifacts(wanted, runlogs.latest_artifacts(listing, usable=F.col("status") != "F"))


# --- text and labels ----------------------------------------------------------------------------


@query
def p1_strip_fence(spark, sf_dir):
    """Whole documents as answers: plain, fenced, with an open fence, and with text after the fence."""
    fence, text, lit = F.lit(X.FENCE), F.col("text"), F.lit
    form = F.col("doc_id") % 4
    answer = (
        F.when(form == 0, text)
        .when(form == 1, F.concat(lit("\n "), fence, lit("json\n"), text, lit("\n"), fence, lit("\t\u00a0")))
        .when(form == 2, F.concat(fence, text))
        .otherwise(F.concat(fence, text, fence, lit(" and more")))
    )
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ex_id"), X.strip_fence(answer).alias("record"))


@query
def p2_parse_records(spark, sf_dir):
    parsed = validate.parse_records(fx.generated_texts(spark, sf_dir))
    return parsed.select(
        "ex_id", "reason", F.when(F.col("reason").isNull(), F.col("log")).alias("log"),
        F.when(F.col("reason").isNull(), joined("root_cause")).alias("codes"),
    )


@query
def p2_label_consistency(spark, sf_dir):
    """Validation with the optional rule that the label is the one asked for."""
    texts = fx.generated_texts(spark, sf_dir).withColumn("asked", fx.label_at("ex_id div 11"))
    parsed = validate.parse_records(texts, vocab=SIGNALLING, expected="asked")
    return parsed.groupBy("asked", "reason").agg(F.count("*").alias("n"))


@query
def p3_quarantine(spark, sf_dir):
    parsed = validate.parse_records(fx.generated_texts(spark, sf_dir))
    return validate.quarantine_report(parsed, ["label"])


@query
def p4_noise_filter(spark, sf_dir):
    """Code lists with noise, blanks, case and repeats."""
    doc = F.col("doc_id")
    mixed = F.array(
        F.lit("HARQ_NACK"), F.when(doc % 3 == 0, F.concat(F.lit("\t "), F.upper(fx.label_at("doc_id")))),
        F.when(doc % 5 != 0, fx.label_at("doc_id")).otherwise("unknown"), F.col("lang"), F.lit(" timer_expiry\n"),
        F.when(doc % 2 == 0, F.initcap(fx.label_at("doc_id + 5"))),
    )
    docs = fx.table(spark, sf_dir, "documents").select(doc.alias("ex_id"), mixed.alias("codes"))
    return docs.select("ex_id", joined(L.filter_noise(F.col("codes"))).alias("kept"))


@query
def p4_event_codes(spark, sf_dir):
    """The same filter on codes that arrive as rows: event types of every user in order of first appearance."""
    events = fx.table(spark, sf_dir, "events")
    kept = codes.filter_noise_rows(events, ["user_id"], "event_type", ["ts", "event_id"], fx.EVENT_TYPES)
    return kept.select("user_id", joined("codes").alias("kept"))


@query
def p5_primary_label(spark, sf_dir):
    stored = fx.stored_predictions(spark, sf_dir)
    return stored.select(*KEY, L.primary_label(F.col("root_cause")).alias("primary"))


@query
def p6_strip_reasoning(spark, sf_dir):
    return L.with_answer_text(fx.predictions(spark, sf_dir)).select(*KEY, "answer")


@query
def p7_json_labels(spark, sf_dir):
    answers = L.with_answer_text(fx.predictions(spark, sf_dir))
    return L.with_json_labels(answers).select(*KEY, joined("json_labels").alias("codes"))


@query
def p8_named_labels(spark, sf_dir):
    answers = L.with_answer_text(fx.predictions(spark, sf_dir)).withColumn("low", F.lower("answer"))
    return answers.select(*KEY, joined(L.named_labels("low")).alias("codes"))


@query
def p9_phrase_labels(spark, sf_dir):
    answers = L.with_answer_text(fx.predictions(spark, sf_dir)).withColumn("folded", X.fold_for_words(F.lower("answer")))
    return answers.select(*KEY, joined(L.synonym_labels("answer", "folded")).alias("codes"))


@query
def p10_extract_cascade(spark, sf_dir):
    return extracted(spark, sf_dir).select(*KEY, joined("codes").alias("codes"), "step")


@query
def p10_extract_language(spark, sf_dir):
    """The cascade with another vocabulary over whole documents."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labelled = L.extract_labels(docs, "text", fx.LANGUAGES, "codes", decided_by="step")
    return labelled.select("doc_id", "lang", joined("codes").alias("codes"), "step")


@query
def p10_long_answers(spark, sf_dir):
    """The cascade on whole documents: the answer forms before, behind and around the text, in and out of reasoning blocks."""
    text, label, form, lit = F.col("text"), fx.label_at("doc_id"), F.col("doc_id") % 8, F.lit
    listed = F.concat(lit('["'), label, lit('"]'))
    prose = fx.label_at("doc_id", fx.PHRASES)
    output = (
        F.when(form == 0, F.concat(text, lit("\n"), listed))
        .when(form == 1, F.concat(listed, lit("\n"), text))
        .when(form == 2, F.concat(lit("<think>"), text, lit("</think>"), listed))
        .when(form == 3, F.concat(lit("<think>"), listed, text))
        .when(form == 4, F.concat(text, lit(" so the cause is "), label, lit(".")))
        .when(form == 5, F.concat(text, lit("\n"), prose, lit("\n"), text))
        .when(form == 6, F.concat(lit("<think>"), prose, lit("</think>"), text))
        .otherwise(F.concat(lit("[AMF] "), text, lit(" ["), text, lit("] "), prose))
    )
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", output.alias("output"))
    return L.extract_labels(docs, out="codes", decided_by="step").select("doc_id", joined("codes").alias("codes"), "step")


@query
def p11_choose_prediction(spark, sf_dir):
    chosen = L.choose_prediction(fx.stored_predictions(spark, sf_dir))
    return chosen.select(*KEY, joined("predicted").alias("codes"), L.primary_label(F.col("predicted")).alias("pred"))


@query
def p11_reextract(spark, sf_dir):
    """Stored labels give way to a new extraction wherever there is a raw answer."""
    chosen = L.choose_prediction(fx.stored_predictions(spark, sf_dir), reextract=True)
    return chosen.select(*KEY, joined("predicted").alias("codes"))


@query
def p12_instruction_pairs(spark, sf_dir):
    return prompts.training_pairs(fx.examples(spark, sf_dir), F.lit("acme/base"), keep=["ex_id"])


@query
def p13_chat_pairs(spark, sf_dir):
    """User turns of conversations as examples, half of them for a chat model."""
    turns = fx.table(spark, sf_dir, "conversations").filter("role = 'user'")
    model = F.when(F.col("conv_id") % 2 == 0, "Qwen/Qwen3-14B").otherwise("acme/base")
    rows = turns.select("conv_id", "turn", model.alias("model"), F.col("text").alias("log"),
                        F.array(fx.label_at("conv_id"), F.lit('a "quoted" label')).alias("root_cause"))
    return prompts.training_pairs(rows, F.col("model"), keep=["conv_id", "turn"])


@query
def p14_inference_prompts(spark, sf_dir):
    model = F.when(F.col("ex_id") % 2 == 0, "Qwen/Qwen3-14B").otherwise("acme/base")
    return fx.examples(spark, sf_dir).select("ex_id", prompts.inference_prompt(F.col("log"), model).alias("prompt"))


def benchmark_shots(spark, sf_dir) -> DataFrame:
    """The first five benchmark items as labelled examples."""
    items = fx.table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("log"), F.array(fx.label_at("item_id")).alias("root_cause")
    )
    return align.first_rows(items, 5, ["item_id"])


@query
def p15_chat_messages(spark, sf_dir):
    """Five examples and the question for every user turn, one row per message."""
    turns = fx.table(spark, sf_dir, "conversations").filter("role = 'user'")
    shots = prompts.shot_turns(benchmark_shots(spark, sf_dir), ["item_id"])
    messages = prompts.chat_messages(F.col("text"), shots, F.col("conv_id") % 2 == 0)
    rows = turns.select("conv_id", "turn", F.posexplode(messages).alias("pos", "message"))
    return rows.select("conv_id", "turn", "pos", "message.role", F.col("message.content")[0]["text"].alias("text"))


@query
def p15_hosted_requests(spark, sf_dir):
    """The same as requests to a hosted model, without examples, one row per user turn."""
    turns = fx.table(spark, sf_dir, "conversations").filter("role = 'user'")
    request = prompts.hosted_request(prompts.chat_messages(F.col("text"), None, F.col("conv_id") % 2 == 0))
    last = F.element_at("request.messages", -1)
    return turns.select("conv_id", "turn", request.alias("request")).select(
        "conv_id", "turn", F.col("request.system")[0]["text"].alias("system"), F.size("request.messages").alias("n_messages"),
        last["content"][0]["text"].alias("text"),
    )


@query
def p16_decode_strategy(spark, sf_dir):
    strategy = F.col("strategy")
    preds = fx.predictions(spark, sf_dir).select(
        "strategy", align.shots_in(strategy).alias("n_shots"), align.uses_reasoning(strategy).alias("use_cot")
    )
    return preds.groupBy("strategy", "n_shots", "use_cot").agg(F.count("*").alias("n"))


@query
def p17_slug(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", X.slug(F.col("url")).alias("slug"), X.slug(F.col("url"), 28).alias("slug_28"),
        X.slug(F.concat(F.col("url"), F.lit("/Some_Model.V2"))).alias("model_slug"),
    )


@query
def p18_percent(spark, sf_dir):
    names = ("f1", "precision", "recall")
    return classes(spark, sf_dir).select(*RUN, "label", *[X.percent(F.col(c)).alias(f"{c}_pct") for c in names])


@query
def p19_prune_columns(spark, sf_dir):
    return prompts.training_pairs(fx.examples(spark, sf_dir), F.lit("acme/base")).select("prompt", "completion")


@query
def p20_rounding(spark, sf_dir):
    """Four-digit ratios with exact halves, which go to the even neighbour."""
    orders = fx.table(spark, sf_dir, "orders")
    part, whole = F.col("o_orderkey") % 33, F.when(F.col("o_custkey") % 2 == 0, 32).otherwise(F.col("o_custkey") % 100)
    return orders.select("o_orderkey", part.alias("part"), whole.alias("whole"), X.ratio(part, whole).alias("share"))


def progress_lines(spark, sf_dir) -> DataFrame:
    """The log of a generation run: counters, failures and the closing line of each split. The texts are parsed once."""
    parsed = validate.parse_records(fx.generated_texts(spark, sf_dir)).select("split", "ex_id", "label", "reason")
    parsed = stage(parsed, "parsed")
    n = F.lit
    sizes = validate.written_and_skipped(parsed, ["split"]).select("split", (F.col("written") + F.col("skipped")).alias("total"))
    counters = runlogs.progress_counters(parsed, ["ex_id"], ["split"]).join(sizes, "split").select(
        "split",
        F.concat(n("  Progress: "), "position", n("/"), "total", n(" | written="), "written", n(" skipped="), "skipped").alias("value"),
    )
    failed = validate.quarantined(parsed).select(
        "split", F.concat(n("  [WARN] Failed after 3 attempts for "), "label", n(": "), "reason").alias("value")
    )
    done = validate.written_and_skipped(parsed, ["split"]).select(
        "split",
        F.concat(n("Done: "), "written", n(" examples written to data/"), "split", n(".jsonl ("), "skipped", n(" skipped)")).alias("value"),
    )
    other = done.select("split", F.lit("Generating examples...").alias("value"))
    return counters.unionByName(failed).unionByName(done).unionByName(other)


@query
def p21_progress_log(spark, sf_dir):
    """The log files of a generation run, one folder per split, as text."""
    path = fresh_path(spark, "progress")
    logs.write_run_logs(progress_lines(spark, sf_dir).withColumnRenamed("split", "run_id"), path)
    return runlogs.parse_progress(logs.read_run_logs(spark, path)).withColumnRenamed("run_id", "split")


@query
def p21_training_log(spark, sf_dir):
    return training_steps(spark, sf_dir)


@query
def p22_training_cost(spark, sf_dir):
    jobs_ = runlogs.training_cost(fx.training_jobs(spark, sf_dir), fx.HOURLY_USD)
    return jobs_.select(
        "job_id", "instance", "billable_seconds", F.col("cost_usd").cast("double").alias("cost_usd"),
        runlogs.steps_per_epoch(F.col("n_examples"), 2, 4).alias("steps_per_epoch"),
        runlogs.cost_per_thousand(F.col("cost_usd"), F.col("n_examples")).cast("double").alias("cost_per_1000"),
    )


@query
def p22_cost_by_instance(spark, sf_dir):
    jobs_ = runlogs.training_cost(fx.training_jobs(spark, sf_dir), fx.HOURLY_USD)
    return jobs_.groupBy("instance").agg(
        F.count("*").alias("n_jobs"), F.sum("billable_seconds").alias("billable_seconds"),
        F.sum("cost_usd").cast("double").alias("cost_usd"),
    )


@query
def p23_generation_prompts(spark, sf_dir):
    scheduled = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ex_id"), schedule.scheduled_label(F.col("doc_id")).alias("label")
    )
    return scheduled.select("ex_id", "label", prompts.generation_prompt(F.col("label")).alias("prompt"))


# --- joins --------------------------------------------------------------------------------------


@query
def j1_align_by_id(spark, sf_dir):
    return paired(spark, sf_dir).select(*KEY, "gold", "pred")


@query
def j1_unpaired(spark, sf_dir):
    """Predictions of every run that no gold row covers."""
    gold = fx.gold_labels(spark, sf_dir).filter("ex_id % 7 <> 3")
    return align.unpaired(gold, fx.predictions(spark, sf_dir), RUN)


@query
def j1_align_by_position(spark, sf_dir):
    """Predictions without ids: the k-th prediction of a short run belongs to a later gold row."""
    preds = extracted(spark, sf_dir).select(*RUN, F.col("ex_id").alias("file_pos"), F.element_at("codes", 1).alias("pred"))
    gold = fx.gold_labels(spark, sf_dir).withColumnRenamed("ex_id", "gold_pos")
    aligned = align.align_by_position(gold, preds, ["gold_pos"], ["file_pos"], RUN)
    return aligned.select(*RUN, "pred_ord", "gold_ord", "gold_pos", "gold", "pred")


@query
def j1_align_files(spark, sf_dir):
    """The same from files without ids, end to end: gold and predictions are numbered by their place in the files."""
    gold_path, path = fresh_path(spark, "gold"), fresh_path(spark, "predictions")
    record = F.to_json(F.struct(F.lit("log").alias("log"), F.array("gold").alias("root_cause")))
    fx.gold_labels(spark, sf_dir).orderBy("ex_id").select(record.alias("value")).write.text(gold_path)
    answers = fx.predictions(spark, sf_dir).orderBy(*KEY).select(*RUN, F.to_json(F.struct("output")).alias("value"))
    answers.write.partitionBy(*RUN).text(path)

    lines = jsonl.read_lines_in_order(spark, gold_path)
    gold = lines.select("file", "block", "line", F.from_json("value", jsonl.EXAMPLES)["root_cause"][0].alias("gold"))
    read = jsonl.read_lines_in_order(spark, path, "model STRING, strategy STRING")
    read = read.select(*RUN, "file", "block", "line", F.from_json("value", jsonl.PREDICTIONS)["output"].alias("output"))
    preds = L.extract_labels(read, out="codes").select(*RUN, "file", "block", "line", F.element_at("codes", 1).alias("pred"))
    return align.align_in_file_order(gold, preds, RUN).select(*RUN, "pred_ord", "gold_ord", "gold", "pred")


@query
def j2_few_shot_split(spark, sf_dir):
    shots, rest = align.split_shots(fx.gold_labels(spark, sf_dir), 5, ["ex_id"])
    return shots.withColumn("is_shot", F.lit(True)).unionByName(rest.withColumn("is_shot", F.lit(False)))


@query
def j3_attach_shots(spark, sf_dir):
    """The same examples on every row, as a constant."""
    shots = align.shot_list(benchmark_shots(spark, sf_dir), ["item_id"])
    turns = fx.table(spark, sf_dir, "conversations").withColumn("shots", shots)
    return turns.select(
        "conv_id", "turn", F.size("shots").alias("n_shots"), F.col("shots")[0]["log"].alias("first_log"),
        F.array_join(F.flatten("shots.root_cause"), "|").alias("shot_codes"),
    )


@query
def j4_display_names(spark, sf_dir):
    """Names from a table where it has them, else the key; kinds fall back to the empty text."""
    names = spark.createDataFrame(list(MODEL_NAMES.items()), "model STRING, name STRING")
    kinds = spark.createDataFrame(list(MODEL_KINDS.items()), "model STRING, name STRING")
    named = leaderboard.with_display_names(scored(spark, sf_dir), names, "model", "model_name")
    named = leaderboard.with_display_names(named, kinds, "model", "kind", F.lit(""))
    return named.select(*RUN, "model_name", "kind", "f1")


@query
def j5_anti_join(spark, sf_dir):
    """Documents that no label covers."""
    docs, known = (fx.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return docs.select("doc_id", "lang").join(known.select("doc_id"), "doc_id", "left_anti")


@query
def j6_label_grid(spark, sf_dir):
    """All labels of every run in fixed order, n = 0 for labels without gold rows; one run has no class row at all."""
    runs = scored(spark, sf_dir).select(*RUN).union(spark.createDataFrame([("m9", "unscored")], "model STRING, strategy STRING"))
    return leaderboard.label_grid(classes(spark, sf_dir), SIGNALLING.labels, runs=runs)


@query
def j6_label_grid_present(spark, sf_dir):
    """The same without the missing labels."""
    return leaderboard.label_grid(classes(spark, sf_dir), SIGNALLING.labels, keep_missing=False)


@query
def j7_highlighted_classes(spark, sf_dir):
    keys = spark.createDataFrame([("m0", "slm"), ("m1", "five_shot"), ("m2", "five_shot_cot")], "model STRING, strategy STRING")
    return leaderboard.select_runs(classes(spark, sf_dir), keys)


@query
def j8_baseline_delta(spark, sf_dir):
    """Every run against the zero-shot run of its model, in points."""
    runs = scored(spark, sf_dir)
    return leaderboard.baseline_delta(runs, F.col("strategy") == "zero_shot", ["model"], ["f1", "precision"], ["strategy"])


@query
def j8_class_delta(spark, sf_dir):
    rows = classes(spark, sf_dir)
    return leaderboard.baseline_delta(rows, F.col("strategy") == "zero_shot", ["model", "label"], ["f1", "recall"], ["strategy"])


@query
def j9_curated_subset(spark, sf_dir):
    """Only the best run of every model stays in the final store."""
    runs = scored(spark, sf_dir)
    return leaderboard.select_runs(runs, leaderboard.best_per(runs, "model"))


# --- aggregations -------------------------------------------------------------------------------


@query
def a1_overall_scores(spark, sf_dir):
    return metrics.overall(cells(spark, sf_dir)).select(*RUN, "f1", "precision", "recall", "n")


@query
def a2_exact_match(spark, sf_dir):
    return metrics.overall(cells(spark, sf_dir)).select(*RUN, "exact_match", "n_correct", "n")


@query
def a3_per_class(spark, sf_dir):
    return classes(spark, sf_dir)


@query
def a3_language_scores(spark, sf_dir):
    """Per-class scores of phrase matching on real documents."""
    vocab = fx.LANGUAGES
    docs = fx.table(spark, sf_dir, "documents").select("lang", "text")
    labelled = L.extract_labels(docs, "text", vocab, "codes").select(
        F.lit("phrases").alias("model"), F.lit("whole_text").alias("strategy"),
        F.concat(F.lit("language_"), "lang").alias("gold"), F.element_at("codes", 1).alias("pred"),
    )
    return metrics.per_class(metrics.confusion_matrix(labelled), labels=vocab.labels)


@query
def a3_quality_scores(spark, sf_dir):
    """Length as a predictor of the quality label; labels are numbers here."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").cast("string").alias("guess"))
    gold = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    pairs = align.align_by_id(gold, docs, "doc_id").select(
        F.lit("length").alias("model"), F.lit("rule").alias("strategy"), F.array("quality").alias("gold_codes"),
        F.array(F.lit("noise"), "guess").alias("pred_codes"),
    )
    labelled = metrics.with_primary_labels(pairs, "gold_codes", "pred_codes", fx.QUALITY)
    return metrics.per_class(metrics.confusion_matrix(labelled), labels=fx.QUALITY.labels)


@query
def a4_confusion_matrix(spark, sf_dir):
    return cells(spark, sf_dir)


@query
def a5_averages(spark, sf_dir):
    return metrics.averages(classes(spark, sf_dir))


@query
def a6_class_distribution(spark, sf_dir):
    return metrics.class_distribution(fx.gold_labels(spark, sf_dir)).orderBy(F.desc("n"), "gold")


@query
def a6_embedding_labels(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    return metrics.class_distribution(rows, "label").orderBy(F.desc("n"), "label")


@query
def a7_predicted_labels(spark, sf_dir):
    preds = extracted(spark, sf_dir).select(*RUN, F.element_at("codes", 1).alias("pred"))
    return metrics.class_distribution(preds, "pred", RUN)


@query
def a7_collapse_report(spark, sf_dir):
    preds = extracted(spark, sf_dir).select(
        *RUN, F.element_at("codes", 1).alias("pred"), (F.col("output") == "").alias("empty"), F.lit(False).alias("defaulted")
    )
    return metrics.prediction_health(preds)


def moody_predictor():
    """Fails for prompts whose length is a multiple of five, and answers with the default for every third."""

    def predict_one(prompts_: list[str]) -> list[str]:
        if any(len(p) % 5 == 0 for p in prompts_):
            raise ValueError("no answer")
        return ["" if len(p) % 3 == 0 else '["congestion"]' for p in prompts_]

    return predict_one


@query
def a7_defaulted_answers(spark, sf_dir):
    """Failed calls of a predictor, by language: they are answered with the default and counted apart."""
    docs = fx.table(spark, sf_dir, "documents").select("lang", F.col("text").alias("prompt"))
    answered = predict.predict_batches(docs, moody_predictor, batch_size=1).select(
        "lang", "output", "defaulted", (F.col("output") == "").alias("empty")
    )
    labelled = L.extract_labels(answered, out="codes").select("lang", "empty", "defaulted", F.element_at("codes", 1).alias("pred"))
    return metrics.prediction_health(labelled, ["lang"])


@query
def a7_code_kinds(spark, sf_dir):
    """Noise apart from unknown codes, over code lists of documents."""
    listed = F.array(
        F.upper("source"), fx.label_at("doc_id"), F.when(F.col("doc_id") % 3 == 0, " Harq_Nack").otherwise("timer_expiry")
    )
    docs = fx.table(spark, sf_dir, "documents").select("lang", listed.alias("codes"))
    return codes.code_kinds(docs, ["lang"], "codes")


@query
def a8_misclassified(spark, sf_dir):
    return metrics.misclassified(cells(spark, sf_dir))


@query
def a8_misclassified_by_class(spark, sf_dir):
    return metrics.misclassified(cells(spark, sf_dir), [*RUN, "gold"])


@query
def a9_written_skipped(spark, sf_dir):
    parsed = validate.parse_records(fx.generated_texts(spark, sf_dir))
    return validate.written_and_skipped(parsed, ["split"])


@query
def a10_class_status(spark, sf_dir):
    return metrics.class_status(classes(spark, sf_dir), 0.6).select(*RUN, "label", "f1", "status")


@query
def a10_perfect_classes(spark, sf_dir):
    return leaderboard.perfect_classes(classes(spark, sf_dir))


@query
def a11_strategy_pivot(spark, sf_dir):
    return leaderboard.strategy_pivot(scored(spark, sf_dir), STRATEGIES)


@query
def a12_training_curves(spark, sf_dir):
    return runlogs.training_summary(training_steps(spark, sf_dir))


@query
def a13_run_invariants(spark, sf_dir):
    return metrics.run_invariants(cells(spark, sf_dir))


@query
def a14_scenario_matrix(spark, sf_dir):
    rows = metrics.class_status(classes(spark, sf_dir), 0.6)
    return leaderboard.scenario_matrix(rows, [(m, s) for _, m, s, _, _ in fx.RUNS])


# --- ranking, windows, sequences ----------------------------------------------------------------


@query
def w1_rank_runs(spark, sf_dir):
    return leaderboard.rank_runs(scored(spark, sf_dir)).select("rank", *RUN, "f1", "n", "n_correct")


@query
def w2_best_run(spark, sf_dir):
    return leaderboard.rank_runs(scored(spark, sf_dir)).filter("is_best").select(*RUN, "f1", "is_best")


@query
def w3_best_per_model(spark, sf_dir):
    return leaderboard.best_per(scored(spark, sf_dir), "model").select(*RUN, "f1", "n")


@query
def w4_running_counters(spark, sf_dir):
    parsed = validate.parse_records(fx.generated_texts(spark, sf_dir))
    return runlogs.progress_counters(parsed, ["ex_id"], ["split"])


@query
def w5_balanced_schedule(spark, sf_dir):
    """A schedule with one place per document."""
    places = sequence.dense_ordinals(fx.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], name="pos")
    return places.select("doc_id", "pos", schedule.scheduled_label(F.col("pos")).alias("label"))


@query
def w5_schedule_range(spark, sf_dir):
    """A schedule as long as the documents table, by label: counts differ by one at most."""
    places = schedule.balanced_schedule(spark, fx.table(spark, sf_dir, "documents").count())
    return places.groupBy("label").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query
def w6_seeded_shuffle(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", fx.label_at("doc_id").alias("label"))
    return schedule.seeded_shuffle(docs, 42, "doc_id")


@query
def w7_mini_batches(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sequence.mini_batches(docs, 4, ["doc_id"])


@query
def w8_first_rows(spark, sf_dir):
    return align.first_rows(fx.examples(spark, sf_dir), 5, ["ex_id"]).select("ex_id", "log", joined("root_cause").alias("codes"))


@query
def w9_loss_progression(spark, sf_dir):
    return runlogs.loss_progression(training_steps(spark, sf_dir))


@query
def w10_best_per_label(spark, sf_dir):
    best = leaderboard.best_per(classes(spark, sf_dir), "label", tie_break=["model", "strategy"])
    return best.select("label", *RUN, "f1", "n")


# --- set operations -----------------------------------------------------------------------------


@query
def u1_append_runs(spark, sf_dir):
    """Replace one run and append another, as tables."""
    runs = scored(spark, sf_dir).select(*RUN, "f1", "n", "store_ord")
    new = runs.filter("store_ord IN (2, 5)").withColumn("store_ord", F.when(F.col("store_ord") == 2, 0).otherwise(1).cast("bigint"))
    return leaderboard.upsert_runs(runs.filter("store_ord < 5"), new)


@query
def u2_dropped_runs(spark, sf_dir):
    runs = scored(spark, sf_dir)
    return leaderboard.drop_runs(runs, leaderboard.best_per(runs, "model"))


# --- batch prediction and streams ---------------------------------------------------------------


@query
def f1_predict_batches(spark, sf_dir):
    """Phrase rules as a stand-in for a model: predict in batches, then extract labels from the answers."""
    vocab = fx.LANGUAGES
    make = partial(predict.phrase_predictor, list(vocab.synonyms), vocab.default)
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    answered = predict.predict_batches(docs, make, batch_size=64, default_answer=f'["{vocab.default}"]')
    labelled = L.extract_labels(answered.drop("prompt"), "output", vocab, "codes")
    return labelled.select("doc_id", "output", "defaulted", joined("codes").alias("codes"))


@query
def t1_follow_training(spark, sf_dir):
    """Training logs followed as a stream; the latest metrics of every run."""
    store, state = (fresh_path(spark, n) for n in ("latest", "state"))
    lines = logs.follow_run_logs(spark, log_files(spark, sf_dir))
    jobs.follow_training(lines, store, state, available_now=True).awaitTermination()
    latest = spark.read.schema("last_step BIGINT, last_loss DOUBLE, last_epoch DOUBLE, n_points BIGINT, run_id STRING").parquet(store)
    return latest.select("run_id", "last_step", "last_loss", "last_epoch", "n_points")


@query
def t1_loss_changes(spark, sf_dir):
    """Losses from step to step while logs grow. Of some runs every third line comes late, of the others the steps from 100 on come later."""
    arriving, store, state = (fresh_path(spark, n) for n in ("arriving", "losses", "state"))
    lines = stage(logs.read_run_logs(spark, log_files(spark, sf_dir)), "lines")
    late = F.when(F.crc32("run_id") % 2 == 0, F.crc32("value") % 3 == 0).otherwise(F.rlike("value", F.lit(r"Step\s+\d{3,}")))
    for part in (~late, late):
        lines.filter(part).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(lines.schema).parquet(arriving)
        jobs.follow_losses(stream, store, state, available_now=True).awaitTermination()
    return jobs.loss_changes(spark, store)


@query
def t2_incremental_scores(spark, sf_dir):
    """Predictions scored as they arrive; every batch puts the runs it saw into the results store, each at a place of its own.

    Two models have only half of their answers at first; when the rest comes, their runs move to the end.
    """
    arriving, counts, state, store = (fresh_path(spark, n) for n in ("arriving", "cells", "state", "store"))
    answers = stage(fx.predictions(spark, sf_dir).select(*KEY, "output"), "answers")
    late = (F.col("ex_id") % 2 == 1) & F.col("model").isin("m0", "m2")
    gold = fx.gold_labels(spark, sf_dir)
    schema = "ex_id BIGINT, output STRING, model STRING, strategy STRING"
    for part in (~late, late):
        answers.filter(part).hint("rebalance", *RUN).write.mode("append").partitionBy(*RUN).parquet(arriving)
        stream = spark.readStream.schema(schema).parquet(arriving)
        jobs.score_increments(stream, gold, counts, state, store, available_now=True).awaitTermination()
    return results_store.overall_rows(results_store.read_store(spark, store))


@query
def t3_label_windows(spark, sf_dir):
    """Event types per hour in event time; only closed windows."""
    out, state = fresh_path(spark, "windows"), fresh_path(spark, "state")
    schema = fx.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    jobs.append_to(jobs.label_windows(events, "event_type"), out, state, available_now=True).awaitTermination()
    closed = spark.read.schema("window_start TIMESTAMP, window_end TIMESTAMP, event_type STRING, n BIGINT").parquet(out)
    return closed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query
def t3_collapse_alarm(spark, sf_dir):
    """Days in which a source of events sent almost nothing but views for hours; only closed days."""
    out, state = fresh_path(spark, "alarms"), fresh_path(spark, "state")
    schema = fx.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    source = events.select("ts", "event_type", (F.col("user_id") % 6).alias("run_id"))
    windows = jobs.collapse_windows(source, "event_type", "view", "run_id", width="4 hours", limit=0.5, least=4)
    jobs.append_to(jobs.collapse_alarm(windows, "run_id"), out, state, available_now=True).awaitTermination()
    alarms = spark.read.schema(
        "run_id BIGINT, period_start TIMESTAMP, period_end TIMESTAMP, n_windows BIGINT, n_collapsed BIGINT, n BIGINT, top_share DOUBLE"
    ).parquet(out)
    return alarms.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("period_start", "period_end")})


@query
def j8_family_delta(spark, sf_dir):
    """Runs under names of the kind a, a-x, a-x-y against the run of the longest registered name that they begin with."""
    names = F.create_map(*[F.lit(x) for r, n in enumerate(FAMILY_RUNS) for x in (r, n)])
    runs = scored(spark, sf_dir).withColumn("model", F.element_at(names, F.col("store_ord").cast("int")))
    families = spark.createDataFrame([(f,) for f in FAMILIES], "family STRING")
    return leaderboard.family_delta(runs, families, [], ["f1", "recall"])


@query
def j9_store_diff(spark, sf_dir):
    """Two stores on disk: a run goes, one comes, one has another score and a class less, the others are equal."""
    full, final = fresh_path(spark, "full"), fresh_path(spark, "final")
    runs = stage(results(spark, sf_dir), "runs")
    results_store.write_store(runs.filter("store_ord < 5"), full)
    other = F.col("store_ord") == 3
    changed = runs.filter("store_ord <> 1").withColumns({
        "metrics": F.when(other, F.col("metrics").withField("f1", F.lit(2.0))).otherwise(F.col("metrics")),
        "per_class": F.when(other, F.map_filter("per_class", lambda k, _: k != "normal")).otherwise(F.col("per_class")),
    })
    results_store.write_store(changed, final)
    return results_store.store_diff(results_store.read_store(spark, full), results_store.read_store(spark, final))


@query
def k1_write_counts(spark, sf_dir):
    """Valid and quarantined records written in one pass, counted while written and again when read."""
    path = fresh_path(spark, "judged")
    written, skipped = jsonl.write_judged(validate.parse_records(fx.generated_texts(spark, sf_dir)), path)
    lines = spark.read.schema("value STRING, kind STRING").text(path)
    reason = F.when(F.col("kind") == "quarantined", F.get_json_object("value", "$.reason"))
    observed = F.when(F.col("kind") == "valid", F.lit(written)).otherwise(F.lit(skipped)).cast("bigint")
    return lines.groupBy("kind", reason.alias("reason")).agg(F.count("*").alias("n"), F.first(observed).alias("observed"))


@query
def k1_repeated_keys(spark, sf_dir):
    """Records with a key that comes twice, at the top, in an item and in another key: the last value counts."""
    path = fresh_path(spark, "records")
    text = F.coalesce("text", F.lit(""))
    log, label, doc = F.to_json(F.struct(text.alias("log"))), fx.label_at("doc_id div 3"), F.col("doc_id").cast("string")
    head = F.regexp_replace(log, r"\}$", "")
    record = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"root_cause":["x"],"log":"first",'), F.substring(head, 2, 1 << 30), F.lit(',"root_cause":["'), label, F.lit('"]}')))
        .when(F.col("doc_id") % 3 == 1, F.concat(head, F.lit(',"root_cause":["'), label, F.lit('",{"q":1,"q":2}]}')))
        .otherwise(F.concat(head, F.lit(',"root_cause":["'), label, F.lit('"],"extra":{"q":1,"q":'), doc, F.lit("}}")))
    )
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ex_id"), record.alias("generated"))
    jsonl.write_records(validate.valid_records(validate.parse_records(docs)), path)
    part = lambda key: F.to_json(F.try_variant_get("record", f"$.{key}", "variant"))
    return jsonl.read_records(spark, path).select(
        "log", joined("root_cause").alias("codes"), part("root_cause").alias("items"), part("extra").alias("extra")
    )


@query
def p11_flips(spark, sf_dir):
    """What a vocabulary with phrases changes against one without: rows that every label gains and loses, by run."""
    plain = Vocabulary(SIGNALLING.labels, SIGNALLING.default, SIGNALLING.noise)
    both = L.extract_labels(L.extract_labels(fx.predictions(spark, sf_dir), out="old", vocab=plain), out="new")
    first = [F.element_at(side, 1).alias(side) for side in ("old", "new")]
    return metrics.label_flips(both.select(*RUN, *first), "old", "new")
