"""The registered queries restated in SQL for another engine (DuckDB dialect)."""

from __future__ import annotations

import re

from ..functions import templates as T
from ..functions.text import FENCE, WHITESPACE
from ..functions.vocab import SIGNALLING
from . import fixtures as fx


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_lit(value: str) -> str:
    """A literal whose control characters are spelled with chr()."""
    parts, plain = [], ""
    for ch in value:
        if ord(ch) < 32 or ord(ch) > 126:
            parts += [lit(plain)] if plain else []
            parts.append(f"chr({ord(ch)})")
            plain = ""
        else:
            plain += ch
    parts += [lit(plain)] if plain or not parts else []
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {text_lit(WHITESPACE)})"


def at(position: str, values=SIGNALLING.labels) -> str:
    return f"{lits(values)}[(({position}) % {len(values)}) + 1]"


def share(num: str, den: str) -> str:
    """num / den with four digits, halves to even, in whole numbers; 0 without a denominator."""
    n, d = f"(CAST({num} AS BIGINT) * 10000)", f"CAST({den} AS BIGINT)"
    up = f"CASE WHEN 2 * ({n} % {d}) > {d} OR (2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN {d} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(({n} // {d}) + {up} AS DOUBLE) / 10000 END"


def keep(codes: str, labels=SIGNALLING.labels, noise=SIGNALLING.noise) -> str:
    """Canonical labels of a list, each once, in order."""
    cleaned = f"list_transform(list_filter({codes}, lambda x: x IS NOT NULL), lambda x: {strip('x')})"
    kept = (
        f"list_transform(list_filter({cleaned}, lambda x: NOT list_contains({lits(noise)}, upper(x)) "
        f"AND list_contains({lits(labels)}, lower(x))), lambda x: lower(x))"
    )
    return f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)"


def or_default(kept: str, default=SIGNALLING.default) -> str:
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {lits([default])} END"


def phrase(text: str, pattern: str) -> str:
    """Does the text hold the phrase? This dialect has no look-ahead, so the two such patterns are restated."""
    if pattern == r"beam\s+failure(?!\s+recovery)":
        return (
            rf"len(regexp_extract_all({text}, '(?i)beam\s+failure')) > "
            rf"len(regexp_extract_all({text}, '(?i)beam\s+failure\s+recovery'))"
        )
    if pattern == r"amf.*fail(?!.*auth)":
        return (
            f"len(list_filter(string_split({text}, chr(10)), lambda l: regexp_matches(l, '(?i)amf.*fail') "
            "AND NOT contains(lower(regexp_extract(l, '(?i)^.*fail(.*)$', 1)), 'auth'))) > 0"
        )
    return f"regexp_matches({text}, {lit('(?i)' + pattern)})"


def phrases(text: str, vocab=SIGNALLING) -> str:
    """Labels whose phrases occur, in table order."""
    found = []
    for label, patterns in vocab.synonym_groups():
        hits = " OR ".join(f"({phrase(text, p)})" for p in patterns)
        found.append(f"CASE WHEN {hits} THEN {lit(label)} END")
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


def cascade(name: str, source: str, text: str, vocab=SIGNALLING) -> dict[str, str]:
    """CTEs that add ``ct`` (answer), ``js``, ``nm``, ``ph``, ``codes`` and ``step`` to a source."""
    default = lits([vocab.default])
    closed = strip(f"regexp_replace({text}, '<think>.*?</think>', '', 'gs')")
    cut = strip("regexp_replace(c1, '<think>.*', '', 's')")
    items = "list_transform(json_extract(b, '$[*]'), lambda j: CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') END)"
    kept = or_default(keep("items", vocab.labels, vocab.noise), vocab.default)
    named = f"list_filter({lits(vocab.labels)}, lambda x: contains(lower(ct), x))"
    return {
        f"{name}1": f"SELECT *, {closed} AS c1 FROM {source}",
        f"{name}2": f"SELECT *, CASE WHEN contains(c1, '<think>') THEN {cut} ELSE c1 END AS c2 FROM {name}1",
        f"{name}3": f"SELECT * EXCLUDE (c1, c2), CASE WHEN c2 = '' THEN {text} ELSE c2 END AS ct FROM {name}2",
        f"{name}4": rf"SELECT *, regexp_extract(ct, '\[.*?\]', 0, 's') AS b, {named} AS nm, {phrases('ct', vocab)} AS ph FROM {name}3",
        f"{name}5": f"SELECT *, CASE WHEN b <> '' AND json_valid(b) THEN {items} END AS items FROM {name}4",
        f"{name}6": f"SELECT *, CASE WHEN items IS NOT NULL THEN {kept} END AS kept FROM {name}5",
        f"{name}7": (
            f"SELECT *, CASE WHEN items IS NOT NULL AND (kept <> {default} OR contains(lower(b), {lit(vocab.default)})) "
            f"THEN kept END AS js FROM {name}6"
        ),
        name: (
            f"SELECT * EXCLUDE (b, items, kept), CASE WHEN js IS NOT NULL THEN js WHEN len(nm) > 0 AND nm <> {default} THEN nm "
            f"WHEN len(ph) > 0 THEN ph ELSE {default} END AS codes, "
            f"CASE WHEN js IS NOT NULL THEN 'json' WHEN len(nm) > 0 AND nm <> {default} THEN 'named' "
            f"WHEN len(ph) > 0 THEN 'phrase' ELSE 'default' END AS step FROM {name}7"
        ),
    }


RUNS = ", ".join(f"({r}, {lit(m)}, {lit(s)}, {q}, {off})" for r, m, s, q, off in fx.RUNS)
CTES: dict[str, str] = {
    "runs(run, model, strategy, q, off)": f"VALUES {RUNS}",
    "base": f"""SELECT run, model, strategy, doc_id, {at('doc_id')} AS g, {at('doc_id + 3')} AS nxt, {at('doc_id', fx.PHRASES)} AS prose,
        CASE WHEN (doc_id * 31 + run * 17) % 10 < q THEN 0 ELSE (doc_id // 8) % 12 END AS form
        FROM documents CROSS JOIN runs WHERE doc_id >= off""",
    "preds": """SELECT run, model, strategy, doc_id AS ex_id, CASE form
        WHEN 0 THEN concat('["', g, '"]')
        WHEN 1 THEN concat('["HARQ_NACK", " ', upper(g), ' ", "', nxt, '"]')
        WHEN 2 THEN concat('<think>maybe ', nxt, chr(10), '</think>["', g, '"]')
        WHEN 3 THEN concat('<think>truncated ', nxt)
        WHEN 4 THEN concat('The root cause is ', g, '.')
        WHEN 5 THEN prose
        WHEN 6 THEN concat('[AMF] log line', chr(10), '["', g, '"]')
        WHEN 7 THEN ''
        WHEN 8 THEN '["HEARTBEAT_TIMEOUT"]'
        WHEN 9 THEN concat('[] then ', prose)
        WHEN 10 THEN concat(g, ' or ', nxt)
        ELSE concat('AMF link fail', chr(10), 'auth ok; ', prose) END AS output FROM base""",
    "gold": f"SELECT doc_id AS ex_id, {at('doc_id')} AS gold FROM documents",
    **cascade("ext", "preds", "output"),
    "flips": f"""SELECT model, strategy, ex_id, codes[1] AS now, CASE WHEN step = 'phrase' THEN {lit(SIGNALLING.default)} ELSE codes[1] END AS was FROM ext""",
    "pairs": "SELECT e.run, e.model, e.strategy, e.ex_id, e.output, g.gold, e.codes[1] AS pred FROM ext e JOIN gold g USING (ex_id)",
    "cells": "SELECT run, model, strategy, gold, pred, count(*) AS n FROM pairs GROUP BY ALL",
    "sides": """SELECT run, model, strategy, gold AS label, CASE WHEN gold = pred THEN n ELSE 0 END AS tp, 0 AS pp, n FROM cells
        UNION ALL SELECT run, model, strategy, pred, 0, n, 0 FROM cells""",
    "counts": """SELECT run, model, strategy, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pp) AS BIGINT) AS pp, CAST(sum(n) AS BIGINT) AS n
        FROM sides GROUP BY ALL HAVING sum(n) > 0""",
    "classes": f"""SELECT run, model, strategy, label, tp, pp, n, {share('2 * tp', 'pp + n')} AS f1, {share('tp', 'pp')} AS "precision",
        {share('tp', 'n')} AS recall FROM counts""",
    "totals": """SELECT run, model, strategy, CAST(sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS BIGINT) AS n_correct,
        CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL""",
    "scored": f"""SELECT model, strategy, {share('2 * n_correct', 'n + n')} AS f1, {share('n_correct', 'n')} AS "precision",
        {share('n_correct', 'n')} AS recall, {share('n_correct', 'n')} AS exact_match, n_correct, n, CAST(run AS BIGINT) AS store_ord FROM totals""",
    "best": "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, strategy) = 1",
    "stored": f"""SELECT model, strategy, ex_id, output,
        CASE ex_id % 3 WHEN 0 THEN ['TIMER_EXPIRY', concat(' ', upper({at('ex_id + 1')}))] WHEN 1 THEN CAST([] AS VARCHAR[]) END AS root_cause FROM preds""",
    "texts0": f"""SELECT doc_id, text, {at('doc_id // 10')} AS label, json_object('log', text, 'root_cause', [{at('doc_id // 10')}])::VARCHAR AS good
        FROM documents""",
    "texts": f"""SELECT CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, doc_id AS ex_id, label, CASE doc_id % 13
        WHEN 0 THEN good
        WHEN 1 THEN concat(chr(10), {lit(FENCE + 'json')}, chr(10), good, chr(10), {lit(FENCE)}, chr(10))
        WHEN 2 THEN concat({lit(FENCE)}, good, {lit(FENCE)})
        WHEN 3 THEN left(good, -2)
        WHEN 4 THEN json_object('log', text)::VARCHAR
        WHEN 5 THEN json_object('log', text, 'root_cause', label)::VARCHAR
        WHEN 6 THEN json_object('log', text, 'root_cause', [])::VARCHAR
        WHEN 7 THEN concat(' ', chr(9), json_object('log', text, 'root_cause', ['x', label], 'extra', doc_id)::VARCHAR, chr(10))
        WHEN 8 THEN concat('[', good, ']')
        WHEN 9 THEN concat(good, ' Hope this helps')
        WHEN 10 THEN concat(left(json_object('log', text)::VARCHAR, -1), ',"root_cause":["', label, '" 1]}}')
        WHEN 11 THEN concat(left(json_object('log', text)::VARCHAR, -1), ',"root_cause":["', label, '"],"log":[1 2]}}')
        ELSE concat(left(json_object('log', text)::VARCHAR, -1), ',', chr(10), ' "root_cause":["', label, '",1,null],"extra":{{"k":[', doc_id, ']}}}}')
        END AS generated FROM texts0""",
    "fenced": f"SELECT *, {strip('generated')} AS t FROM texts",
    "records": f"""SELECT * EXCLUDE (t), CASE WHEN starts_with(t, {lit(FENCE)}) THEN
        {strip("regexp_replace(string_split(t, " + lit(FENCE) + ")[2], '^json', '')")} ELSE t END AS record FROM fenced""",
    "checked": """SELECT *, CASE WHEN NOT json_valid(record) THEN 'not a JSON object' WHEN json_type(record) <> 'OBJECT' THEN 'not a JSON object'
        WHEN NOT json_exists(record, '$.log') OR NOT json_exists(record, '$.root_cause') THEN 'missing key'
        WHEN json_type(record, '$.root_cause') <> 'ARRAY' THEN 'root_cause is not a list'
        WHEN json_array_length(record, '$.root_cause') = 0 THEN 'root_cause is empty' END AS reason FROM records""",
    "parsed": """SELECT split, ex_id, label, reason, CASE WHEN reason IS NULL THEN json_extract_string(record, '$.log') END AS log,
        CASE WHEN reason IS NULL THEN list_filter(list_transform(json_extract(record, '$.root_cause[*]'),
          lambda j: CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') END), lambda x: x IS NOT NULL) END AS root_cause,
        CASE WHEN reason IS NULL THEN json_extract(record, '$.root_cause')::VARCHAR END AS items,
        CASE WHEN reason IS NULL THEN json_extract(record, '$.extra')::VARCHAR END AS extra FROM checked""",
    "counters": """SELECT split, ord AS position, written, skipped FROM (SELECT split,
        row_number() OVER w AS ord, CAST(count(*) FILTER (reason IS NULL) OVER w AS BIGINT) AS written,
        CAST(count(*) FILTER (reason IS NOT NULL) OVER w AS BIGINT) AS skipped
        FROM checked WINDOW w AS (PARTITION BY split ORDER BY ex_id ROWS UNBOUNDED PRECEDING)) WHERE ord % 50 = 0""",
    "tlines0": """SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders""",
    "tlines1": """SELECT *, printf('%.4f', (cents % 50000) / 10000) AS loss_text, printf('%.4f', (o_custkey % 500) / 100) AS norm_text,
        printf('%.2f', (o_orderkey % 400) / 100) AS epoch_text FROM tlines0""",
    "tlines": """SELECT concat('job-', CASE WHEN o_orderkey % 8 < 5 THEN 0 ELSE o_orderkey % 8 END) AS run_id, CASE o_orderkey % 5
        WHEN 0 THEN concat(' 99%|#########| ', o_orderkey, '/325 [40:35<00:20,  6.84s/it]')
        WHEN 1 THEN concat('{''loss'': ', loss_text, ', ''grad_norm'': ', norm_text, ', ''learning_rate'': 0.0, ''epoch'': ', epoch_text, '}')
        ELSE concat('Step ', lpad(CAST(o_orderkey * 25 AS VARCHAR), 10, ' '), '  | loss: ', loss_text, ' | grad_norm: ', norm_text,
            ' | lr: 1.', o_orderkey % 9, 'e-04 | epoch: ', epoch_text) END AS value FROM tlines1""",
    "tparsed": r"""SELECT run_id, CASE WHEN value LIKE 'Step%' THEN 'step' ELSE 'metrics' END AS kind,
        TRY_CAST(regexp_extract(value, 'Step\s+(\d+)', 1) AS BIGINT) AS step,
        CAST(regexp_extract(value, 'loss''?: ([^ ,]+)', 1) AS DOUBLE) AS loss,
        CAST(regexp_extract(value, 'grad_norm''?: ([^ ,]+)', 1) AS DOUBLE) AS grad_norm,
        CAST(regexp_extract(value, '(lr|learning_rate)''?: ([^ ,]+)', 2) AS DOUBLE) AS lr,
        CAST(regexp_extract(value, 'epoch''?: ([^ },]+)', 1) AS DOUBLE) AS epoch FROM tlines WHERE value LIKE '%loss%'""",
    "jobs": f"""SELECT o_orderkey AS job_id, {at('o_orderkey', tuple(fx.HOURLY_USD))} AS instance,
        CAST(floor(o_totalprice / 50) AS BIGINT) AS billable_seconds, o_custkey + 1 AS n_examples FROM orders""",
    "costs": "SELECT *, (2 * billable_seconds * CASE instance "
    + " ".join(f"WHEN {lit(k)} THEN {round(float(v) * 1000)}" for k, v in fx.HOURLY_USD.items())
    + " END + 36000) // 72000 AS cents FROM jobs",
    "shots": f"SELECT item_id, text AS log, {at('item_id')} AS code FROM benchmark ORDER BY item_id LIMIT 5",
    "long0": f"""SELECT doc_id, text, {at('doc_id')} AS label, {at('doc_id', fx.PHRASES)} AS prose FROM documents""",
    "longs": """SELECT doc_id, CASE doc_id % 8
        WHEN 0 THEN concat(text, chr(10), '["', label, '"]')
        WHEN 1 THEN concat('["', label, '"]', chr(10), text)
        WHEN 2 THEN concat('<think>', text, '</think>["', label, '"]')
        WHEN 3 THEN concat('<think>["', label, '"]', text)
        WHEN 4 THEN concat(text, ' so the cause is ', label, '.')
        WHEN 5 THEN concat(text, chr(10), prose, chr(10), text)
        WHEN 6 THEN concat('<think>', prose, '</think>', text)
        ELSE concat('[AMF] ', text, ' [', text, '] ', prose) END AS output FROM long0""",
    **cascade("lngx", "longs", "output"),
    "turns": "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'",
    **cascade("lng", "documents", "text", fx.LANGUAGES),
}


def needed(sql: str) -> list[str]:
    """The CTEs a statement uses, with those that they use, in order of definition."""
    used, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\b[a-z]\w*\b", todo.pop()))
        for head, body in CTES.items():
            if head.split("(")[0] in words and head not in used:
                used.add(head)
                todo.append(body)
    return [head for head in CTES if head in used]


def sql(body: str) -> str:
    heads = needed(body)
    ctes = ",\n".join(f"{head} AS ({CTES[head]})" for head in heads)
    return f"WITH {ctes}\n{body}" if heads else body


def fill(template: str, **values: str) -> str:
    """SQL expression for a template with marks replaced by SQL expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    shown = [values[p] if i % 2 and p in values else text_lit("{" + p + "}" if i % 2 else p) for i, p in enumerate(parts)]
    return "concat(" + ", ".join(s for s in shown if s != "''") + ")"


PCT = "printf('%.2f%%', {} * 100)"
JOIN = "array_to_string({}, '|')"
INSTRUCTION = fill(T.INSTRUCTION_PROMPT, log="log")
CHAT = fill(T.CHAT_PROMPT, system=text_lit(T.CHAT_SYSTEM), log="log")
CHAT_QUIET = fill(T.CHAT_PROMPT, system=text_lit(T.CHAT_SYSTEM + T.NO_REASONING), log="log")
EXAMPLES = f"(SELECT doc_id AS ex_id, text AS log, {at('doc_id')} AS code FROM documents)"
ANSWER = """concat('["', code, '"]')"""
SCENARIO = "CASE label " + " ".join(f"WHEN {lit(k)} THEN {text_lit(v)}" for k, v in T.SCENARIOS.items()) + " END"
LABEL_JSON = "[" + ", ".join(f'"{x}"' for x in SIGNALLING.labels) + "]"
GENERATION = fill(
    T.GENERATION_CONTRACT.replace('{"log"', '\x00"log"'), scenario=SCENARIO, labels=lit(LABEL_JSON), label="label"
).replace("chr(0)", "'{'")
LABEL_ROWS = "(VALUES " + ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(SIGNALLING.labels)) + ") l(label_ord, label)"
NAME_OF = {
    "model_name": "CASE model WHEN 'm0' THEN 'Model Zero' WHEN 'm1' THEN 'Model One' WHEN 'm2' THEN 'Model Two' ELSE model END",
    "kind": "CASE model WHEN 'm0' THEN 'local' WHEN 'm1' THEN 'hosted' WHEN 'm2' THEN 'hosted' ELSE '' END",
    "strategy_name": "CASE strategy WHEN 'slm' THEN 'Fine-tuned' WHEN 'zero_shot' THEN 'Zero-shot' WHEN 'five_shot' THEN '5-shot' ELSE strategy END",
}
SLUG = "translate(lower(string_split({}, '/')[-1]), '._', '--')"


def points(new: str, old: str) -> str:
    return f"round(({new} - {old}) * 100, 2)"


def _class_scores(source: str, model: str, strategy: str) -> str:
    """Per-class scores from a table with gold and pred."""
    return f"""SELECT '{model}' AS model, '{strategy}' AS strategy, label, tp, pp, n, {share('2 * tp', 'pp + n')} AS f1,
        {share('tp', 'pp')} AS "precision", {share('tp', 'n')} AS recall FROM (
        SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pp) AS BIGINT) AS pp, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT gold AS label, CASE WHEN gold = pred THEN 1 ELSE 0 END AS tp, 0 AS pp, 1 AS n FROM {source}
          UNION ALL SELECT pred, 0, 1, 0 FROM {source}) GROUP BY label HAVING sum(n) > 0)"""


ORACLES: dict[str, str] = {
    "s1_read_examples": f"SELECT ex_id, log, code AS codes FROM {EXAMPLES}",
    "s1_read_examples_lenient": f"""SELECT CASE WHEN ex_id % 7 <> 3 THEN code END AS label, ex_id % 7 = 3 AS corrupt, count(*) AS n,
        CAST(sum(CASE WHEN ex_id % 7 <> 3 THEN length(log) END) AS BIGINT) AS n_chars FROM {EXAMPLES} GROUP BY ALL""",
    "s2_read_predictions": f"SELECT model, strategy, ex_id, {JOIN.format('root_cause')} AS codes, output, CAST(NULL AS VARCHAR) AS raw FROM stored",
    "s3_read_training_folder": f"""SELECT via, code AS label, count(*) AS n, CAST(sum(length(log)) AS BIGINT) AS n_chars
        FROM {EXAMPLES}, (VALUES ('folder'), ('glob')) v(via) GROUP BY ALL""",
    "s4_read_results": """SELECT model, strategy, CAST(run AS BIGINT) AS store_ord, label, f1, "precision", recall, n FROM classes""",
    "s5_training_log_lines": """SELECT run_id, kind, count(*) AS n, max(step) AS last_step, max(loss) AS max_loss FROM tparsed GROUP BY ALL""",
    "s6_rows_per_run": """SELECT *, n_rows = n_expected AS complete FROM (SELECT model, strategy, count(*) AS n_rows,
        (SELECT count(*) FROM documents) - CASE WHEN strategy LIKE '%five%' THEN 5 ELSE 0 END AS n_expected FROM preds GROUP BY ALL)""",
    "s7_latest_artifact": f"""SELECT slug, max(concat('output/', slug, '/train-', left(slug, 28), '-', strftime(o_orderdate, '%Y-%m-%d'), '-',
        lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), '/')) AS latest, count(*) AS n_candidates
        FROM (SELECT *, {SLUG.format(at('o_custkey', fx.BASE_MODELS))} AS slug FROM orders) WHERE o_orderstatus <> 'F' GROUP BY slug""",
    "s7_list_storage": f"""SELECT concat('slug=', slug) AS slug, max(concat('slug=', slug, '/job=', month, '/')) AS latest,
        count(DISTINCT month) AS n_candidates FROM (SELECT {SLUG.format(at('o_custkey', fx.BASE_MODELS))} AS slug,
        strftime(o_orderdate, '%Y-%m') AS month FROM orders) WHERE right(month, 2) <> '12' GROUP BY slug""",
    "s7_required_artifacts": f"""SELECT slug, max(concat('output/', slug, '/train-', left(slug, 28), '-', strftime(o_orderdate, '%Y-%m-%d'), '-',
        lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), '/')) AS latest, count(*) AS n_candidates
        FROM (SELECT *, {SLUG.format(at('o_custkey', fx.BASE_MODELS))} AS slug FROM orders) WHERE o_orderstatus <> 'F' GROUP BY slug""",
    "k1_write_examples": f"SELECT log, {JOIN.format('root_cause')} AS codes, items, extra FROM parsed WHERE reason IS NULL",
    "k2_write_predictions": f"""SELECT model, strategy, ex_id, {JOIN.format('codes')} AS codes,
        CASE WHEN strategy LIKE '%cot%' THEN output ELSE '' END AS raw FROM ext""",
    "k3_upsert_store": """SELECT model, strategy, f1, "precision", recall, exact_match, n,
        CASE WHEN store_ord = 1 THEN 5 WHEN store_ord = 5 THEN 6 ELSE store_ord END AS store_ord FROM scored""",
    "k3_first_run": """SELECT model, strategy, f1, "precision", recall, exact_match, n, store_ord FROM scored WHERE store_ord IN (2, 4)""",
    "k3_repeated_key": """SELECT model, strategy, f1, "precision", recall, exact_match, n, CASE WHEN store_ord = 3 THEN 19 ELSE store_ord + 10 END AS store_ord
        FROM scored""",
    "k4_read_one_run": "SELECT model, strategy, ex_id, output FROM preds WHERE model = 'm1' AND strategy = 'five_shot'",
    "k5_report_summary": f"""SELECT CAST(rank AS INTEGER) AS rank, rank = 1 AS is_best, {NAME_OF['model_name']} AS model_name,
        {NAME_OF['kind']} AS kind, {NAME_OF['strategy_name']} AS strategy_name, {PCT.format('f1')} AS f1_pct,
        {PCT.format('"precision"')} AS precision_pct, {PCT.format('recall')} AS recall_pct, {PCT.format('exact_match')} AS exact_match_pct, n
        FROM (SELECT *, row_number() OVER (ORDER BY f1 DESC, store_ord) AS rank FROM scored)""",
    "k5_report_classes": f"""SELECT b.model, b.strategy, label_ord, l.label, coalesce({PCT.format('c.f1')}, '-') AS f1,
        coalesce({PCT.format('c."precision"')}, '-') AS "precision", coalesce({PCT.format('c.recall')}, '-') AS recall,
        coalesce(c.n, 0) AS n, coalesce(c.f1 = 1, false) AS perfect FROM best b CROSS JOIN {LABEL_ROWS}
        LEFT JOIN classes c ON c.model = b.model AND c.strategy = b.strategy AND c.label = l.label""",
    "p1_strip_fence": f"""SELECT ex_id, CASE WHEN starts_with(t, {lit(FENCE)}) THEN
        {strip("regexp_replace(string_split(t, " + lit(FENCE) + ")[2], '^json', '')")} ELSE t END AS record FROM (
        SELECT ex_id, {strip('answer')} AS t FROM (SELECT doc_id AS ex_id, CASE doc_id % 4 WHEN 0 THEN text
          WHEN 1 THEN concat(chr(10), ' ', {lit(FENCE + 'json')}, chr(10), text, chr(10), {lit(FENCE)}, chr(9), chr(160))
          WHEN 2 THEN concat({lit(FENCE)}, text) ELSE concat({lit(FENCE)}, text, {lit(FENCE)}, ' and more') END AS answer FROM documents))""",
    "p2_parse_records": f"SELECT ex_id, reason, log, {JOIN.format('root_cause')} AS codes FROM parsed",
    "p2_label_consistency": f"""SELECT asked, coalesce(reason, CASE WHEN found[1] <> asked THEN 'label differs' END) AS reason, count(*) AS n FROM (
        SELECT {at('ex_id // 11')} AS asked, reason, {or_default(keep('root_cause'))} AS found FROM parsed) GROUP BY ALL""",
    "p3_quarantine": "SELECT label, reason, count(*) AS n_skipped FROM checked WHERE reason IS NOT NULL GROUP BY ALL",
    "p4_noise_filter": f"""SELECT ex_id, {JOIN.format(or_default(keep('codes')))} AS kept FROM (SELECT doc_id AS ex_id, ['HARQ_NACK',
        CASE WHEN doc_id % 3 = 0 THEN concat(chr(9), ' ', upper({at('doc_id')})) END,
        CASE WHEN doc_id % 5 <> 0 THEN {at('doc_id')} ELSE 'unknown' END, lang, concat(' timer_expiry', chr(10)),
        CASE WHEN doc_id % 2 = 0 THEN concat(upper(left({at('doc_id + 5')}, 1)), {at('doc_id + 5')}[2:]) END] AS codes FROM documents)""",
    "p4_event_codes": f"""SELECT user_id, {JOIN.format(or_default('(' + keep("codes", fx.EVENT_TYPES.labels, fx.EVENT_TYPES.noise) + ')', 'view'))} AS kept
        FROM (SELECT user_id, list(event_type ORDER BY ts, event_id) AS codes FROM events GROUP BY user_id)""",
    "p5_primary_label": f"SELECT model, strategy, ex_id, ({or_default(keep('root_cause'))})[1] AS primary FROM stored",
    "p6_strip_reasoning": "SELECT model, strategy, ex_id, ct AS answer FROM ext",
    "p7_json_labels": f"SELECT model, strategy, ex_id, {JOIN.format('js')} AS codes FROM ext",
    "p8_named_labels": f"SELECT model, strategy, ex_id, {JOIN.format('nm')} AS codes FROM ext",
    "p9_phrase_labels": f"SELECT model, strategy, ex_id, {JOIN.format('ph')} AS codes FROM ext",
    "p10_extract_cascade": f"SELECT model, strategy, ex_id, {JOIN.format('codes')} AS codes, step FROM ext",
    "p10_long_answers": f"SELECT doc_id, {JOIN.format('codes')} AS codes, step FROM lngx",
    "p10_extract_language": f"SELECT doc_id, lang, {JOIN.format('codes')} AS codes, step FROM lng",
    "p11_choose_prediction": f"""SELECT model, strategy, ex_id, {JOIN.format('chosen')} AS codes, ({or_default(keep('chosen'))})[1] AS pred FROM (
        SELECT s.model, s.strategy, s.ex_id, CASE WHEN len(s.root_cause) > 0 THEN s.root_cause ELSE e.codes END AS chosen
        FROM stored s JOIN ext e USING (model, strategy, ex_id))""",
    "p11_reextract": f"""SELECT model, strategy, ex_id,
        {JOIN.format("CASE WHEN len(s.root_cause) > 0 AND s.output = '' THEN s.root_cause ELSE e.codes END")} AS codes
        FROM stored s JOIN ext e USING (model, strategy, ex_id)""",
    "p12_instruction_pairs": f"SELECT ex_id, {INSTRUCTION} AS prompt, {ANSWER} AS completion FROM {EXAMPLES}",
    "p13_chat_pairs": f"""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN {CHAT} ELSE {INSTRUCTION} END AS prompt,
        concat('["', {at('conv_id')}, '", "a \\"quoted\\" label"]', CASE WHEN conv_id % 2 = 0 THEN '{T.CHAT_END}' ELSE '' END) AS completion
        FROM (SELECT *, text AS log FROM turns)""",
    "p14_inference_prompts": f"SELECT ex_id, CASE WHEN ex_id % 2 = 0 THEN {CHAT_QUIET} ELSE {INSTRUCTION} END AS prompt FROM {EXAMPLES}",
    "p15_chat_messages": f"""SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, role, text FROM (
        SELECT conv_id, turn, 2 * item_id AS pos, 'user' AS role, log AS text FROM turns CROSS JOIN shots
        UNION ALL SELECT conv_id, turn, 2 * item_id + 1, 'assistant', {ANSWER} FROM turns CROSS JOIN shots
        UNION ALL SELECT conv_id, turn, 10, 'user', concat(text, CASE WHEN conv_id % 2 = 0 THEN {text_lit(T.REASONING_SUFFIX)} ELSE '' END) FROM turns)""",
    "p15_hosted_requests": f"""SELECT conv_id, turn, {text_lit(T.HOSTED_SYSTEM)} AS system, CAST(1 AS INTEGER) AS n_messages,
        concat(text, CASE WHEN conv_id % 2 = 0 THEN {text_lit(T.REASONING_SUFFIX)} ELSE '' END) AS text FROM turns""",
    "p16_decode_strategy": """SELECT strategy, CASE WHEN strategy LIKE '%five%' THEN 5 ELSE 0 END AS n_shots,
        strategy LIKE '%cot%' AS use_cot, count(*) AS n FROM preds GROUP BY ALL""",
    "p17_slug": f"""SELECT page_id, {SLUG.format('url')} AS slug, left({SLUG.format('url')}, 28) AS slug_28,
        {SLUG.format("concat(url, '/Some_Model.V2')")} AS model_slug FROM pages""",
    "p18_percent": f"""SELECT model, strategy, label, {PCT.format('f1')} AS f1_pct, {PCT.format('"precision"')} AS precision_pct,
        {PCT.format('recall')} AS recall_pct FROM classes""",
    "p19_prune_columns": f"SELECT {INSTRUCTION} AS prompt, {ANSWER} AS completion FROM {EXAMPLES}",
    "p20_rounding": f"""SELECT o_orderkey, part, whole, {share('part', 'whole')} AS share FROM (SELECT o_orderkey, o_orderkey % 33 AS part,
        CASE WHEN o_custkey % 2 = 0 THEN 32 ELSE o_custkey % 100 END AS whole FROM orders)""",
    "p21_progress_log": """SELECT split, 'progress' AS kind, position, (SELECT count(*) FROM checked k WHERE k.split = counters.split) AS total,
        written, skipped, CAST(NULL AS INTEGER) AS attempts,
        CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS target FROM counters
        UNION ALL SELECT split, 'failed', NULL, NULL, NULL, NULL, 3, label, reason, NULL FROM checked WHERE reason IS NOT NULL
        UNION ALL SELECT split, 'done', NULL, NULL, count(*) FILTER (reason IS NULL), count(*) FILTER (reason IS NOT NULL), NULL, NULL, NULL,
          concat('data/', split, '.jsonl') FROM checked GROUP BY split""",
    "p21_training_log": "SELECT *, CAST(NULL AS DOUBLE) AS runtime_s, CAST(NULL AS DOUBLE) AS mean_loss FROM tparsed",
    "p22_training_cost": """SELECT job_id, instance, billable_seconds, CAST(cents AS DOUBLE) / 100 AS cost_usd,
        CAST(ceil(n_examples / 8) AS BIGINT) AS steps_per_epoch,
        CAST((2 * cents * 100000 + n_examples) // (2 * n_examples) AS DOUBLE) / 10000 AS cost_per_1000 FROM costs""",
    "p22_cost_by_instance": """SELECT instance, count(*) AS n_jobs, CAST(sum(billable_seconds) AS BIGINT) AS billable_seconds,
        CAST(sum(cents) AS DOUBLE) / 100 AS cost_usd FROM costs GROUP BY instance""",
    "p23_generation_prompts": f"SELECT ex_id, label, {GENERATION} AS prompt FROM (SELECT doc_id AS ex_id, {at('doc_id')} AS label FROM documents)",
    "j1_align_by_id": "SELECT model, strategy, ex_id, gold, pred FROM pairs",
    "j1_unpaired": "SELECT model, strategy, count(*) AS n_rows, count(*) FILTER (ex_id % 7 = 3) AS n_unpaired FROM preds GROUP BY ALL",
    "j1_align_by_position": """SELECT p.model, p.strategy, p.pred_ord, g.gold_ord, g.gold_pos, g.gold, p.pred FROM (
          SELECT model, strategy, codes[1] AS pred, row_number() OVER (PARTITION BY model, strategy ORDER BY ex_id) - 1 AS pred_ord,
            (SELECT count(*) FROM documents) - count(*) OVER (PARTITION BY model, strategy) AS shift FROM ext) p
        JOIN (SELECT ex_id AS gold_pos, gold, row_number() OVER (ORDER BY ex_id) - 1 AS gold_ord FROM gold) g ON g.gold_ord = p.pred_ord + p.shift""",
    "j1_align_files": """SELECT p.model, p.strategy, p.pred_ord, g.gold_ord, g.gold, p.pred FROM (
          SELECT model, strategy, codes[1] AS pred, row_number() OVER (PARTITION BY model, strategy ORDER BY ex_id) - 1 AS pred_ord,
            (SELECT count(*) FROM documents) - count(*) OVER (PARTITION BY model, strategy) AS shift FROM ext) p
        JOIN (SELECT gold, row_number() OVER (ORDER BY ex_id) - 1 AS gold_ord FROM gold) g ON g.gold_ord = p.pred_ord + p.shift""",
    "j2_few_shot_split": "SELECT ex_id, gold, row_number() OVER (ORDER BY ex_id) <= 5 AS is_shot FROM gold",
    "j3_attach_shots": """SELECT conv_id, turn, CAST(5 AS INTEGER) AS n_shots, (SELECT log FROM shots ORDER BY item_id LIMIT 1) AS first_log,
        (SELECT string_agg(code, '|' ORDER BY item_id) FROM shots) AS shot_codes FROM conversations""",
    "j4_display_names": f"SELECT model, strategy, {NAME_OF['model_name']} AS model_name, {NAME_OF['kind']} AS kind, f1 FROM scored",
    "j5_anti_join": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j6_label_grid": f"""SELECT r.model, r.strategy, label_ord, l.label, tp, pp, f1, "precision", recall, coalesce(n, 0) AS n
        FROM (SELECT model, strategy FROM scored UNION ALL SELECT 'm9', 'unscored') r CROSS JOIN {LABEL_ROWS}
        LEFT JOIN classes c ON c.model = r.model AND c.strategy = r.strategy AND c.label = l.label""",
    "j6_label_grid_present": f"""SELECT model, strategy, label, tp, pp, n, f1, "precision", recall, label_ord FROM classes JOIN {LABEL_ROWS} USING (label)""",
    "j7_highlighted_classes": """SELECT model, strategy, label, tp, pp, n, f1, "precision", recall FROM classes
        WHERE (model, strategy) IN (('m0', 'slm'), ('m1', 'five_shot'), ('m2', 'five_shot_cot'))""",
    "j8_baseline_delta": f"""SELECT r.model, r.strategy, r.f1, b.f1 AS baseline_f1, r."precision", b."precision" AS baseline_precision,
        {points('r.f1', 'b.f1')} AS f1_change, {points('r."precision"', 'b."precision"')} AS precision_change
        FROM scored r LEFT JOIN (SELECT * FROM scored WHERE strategy = 'zero_shot') b USING (model)""",
    "j8_class_delta": f"""SELECT r.model, r.label, r.strategy, r.f1, b.f1 AS baseline_f1, r.recall, b.recall AS baseline_recall,
        {points('r.f1', 'b.f1')} AS f1_change, {points('r.recall', 'b.recall')} AS recall_change
        FROM classes r LEFT JOIN (SELECT * FROM classes WHERE strategy = 'zero_shot') b USING (model, label)""",
    "j9_curated_subset": "SELECT * FROM best",
    "a1_overall_scores": 'SELECT model, strategy, f1, "precision", recall, n FROM scored',
    "a2_exact_match": "SELECT model, strategy, exact_match, n_correct, n FROM scored",
    "a3_per_class": 'SELECT model, strategy, label, tp, pp, n, f1, "precision", recall FROM classes',
    "a3_language_scores": _class_scores("(SELECT concat('language_', lang) AS gold, codes[1] AS pred FROM lng)", "phrases", "whole_text"),
    "a3_quality_scores": _class_scores(
        "(SELECT CAST(quality AS VARCHAR) AS gold, CASE WHEN n_chars >= 1000 THEN '1' ELSE '0' END AS pred FROM labels JOIN documents USING (doc_id))",
        "length", "rule",
    ),
    "a4_confusion_matrix": "SELECT model, strategy, gold, pred, n FROM cells",
    "a5_averages": """SELECT model, strategy, count(*) AS n_classes, round_even(avg(f), 4) AS macro_f1, round_even(sum(f * n) / sum(n), 4) AS weighted_f1,
        round_even(avg(p), 4) AS macro_precision, round_even(sum(p * n) / sum(n), 4) AS weighted_precision, round_even(avg(r), 4) AS macro_recall,
        round_even(sum(r * n) / sum(n), 4) AS weighted_recall FROM (SELECT model, strategy, n, 2 * tp / (pp + n) AS f,
          CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS p, tp / n AS r FROM counts) GROUP BY ALL""",
    "a6_class_distribution": "SELECT gold, count(*) AS n FROM gold GROUP BY gold",
    "a6_embedding_labels": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "a7_predicted_labels": "SELECT model, strategy, codes[1] AS pred, count(*) AS n FROM ext GROUP BY ALL",
    "a7_collapse_report": f"""SELECT *, {share('n_default', 'n')} AS default_share FROM (SELECT model, strategy, count(*) AS n,
        count(*) FILTER (codes[1] = 'normal') AS n_default, count(*) FILTER (output = '') AS n_empty, CAST(0 AS BIGINT) AS n_defaulted,
        count(DISTINCT codes[1]) AS n_labels FROM ext GROUP BY ALL)""",
    "a7_defaulted_answers": f"""SELECT *, {share('n_default', 'n')} AS default_share FROM (SELECT lang, count(*) AS n,
        count(*) FILTER (len(text) % 5 = 0 OR len(text) % 3 = 0) AS n_default, count(*) FILTER (len(text) % 5 <> 0 AND len(text) % 3 = 0) AS n_empty,
        count(*) FILTER (len(text) % 5 = 0) AS n_defaulted,
        count(DISTINCT CASE WHEN len(text) % 5 = 0 OR len(text) % 3 = 0 THEN 'normal' ELSE 'congestion' END) AS n_labels
        FROM documents GROUP BY lang)""",
    "a7_code_kinds": f"""SELECT lang, CASE WHEN list_contains({lits(SIGNALLING.noise)}, upper({strip('code')})) THEN 'noise'
        WHEN list_contains({lits(SIGNALLING.labels)}, lower({strip('code')})) THEN 'label' ELSE 'unknown' END AS kind, count(*) AS n
        FROM (SELECT lang, unnest([upper(source), {at('doc_id')}, CASE WHEN doc_id % 3 = 0 THEN ' Harq_Nack' ELSE 'timer_expiry' END]) AS code
        FROM documents) GROUP BY ALL""",
    "a8_misclassified": "SELECT model, strategy, count(*) FILTER (gold <> pred) AS n_wrong, count(*) AS n FROM pairs GROUP BY ALL",
    "a8_misclassified_by_class": "SELECT model, strategy, gold, count(*) FILTER (gold <> pred) AS n_wrong, count(*) AS n FROM pairs GROUP BY ALL",
    "a9_written_skipped": """SELECT split, count(*) FILTER (reason IS NULL) AS written, count(*) FILTER (reason IS NOT NULL) AS skipped
        FROM checked GROUP BY split""",
    "a10_class_status": """SELECT model, strategy, label, f1, CASE WHEN f1 = 1 THEN 'PERFECT' WHEN tp = 0 AND pp > 0 THEN 'ALL FP'
        WHEN f1 < 0.6 THEN 'NEAR FAIL' ELSE '' END AS status FROM classes""",
    "a10_perfect_classes": "SELECT model, strategy, count(*) FILTER (f1 = 1) AS n_perfect, count(*) AS n_classes FROM classes GROUP BY ALL",
    "a11_strategy_pivot": f"""SELECT *, {points('five_shot', 'zero_shot')} AS few_shot_gain, {points('five_shot_cot', 'five_shot')} AS cot_gain FROM (
        SELECT model, {', '.join(f"max(f1) FILTER (strategy = '{s}') AS {s}" for s in ('slm', 'zero_shot', 'five_shot', 'five_shot_cot'))}
        FROM scored GROUP BY model)""",
    "a12_training_curves": """SELECT run_id, count(*) AS n_points, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss,
        min(loss) AS min_loss, round(avg(loss), 4) AS mean_loss, max(step) AS last_step, arg_max(epoch, step) AS last_epoch
        FROM tparsed WHERE step IS NOT NULL GROUP BY run_id""",
    "a13_run_invariants": """SELECT s.model, s.strategy, s.n, c.n_sum AS n_classes_sum, s.n = c.n_sum AS support_adds_up,
        abs(c.recall - s.f1) <= 0.0001 AS recall_equals_micro_f1, abs(s.recall - s.f1) <= 0.0001 AS f1_is_harmonic_mean
        FROM scored s JOIN (SELECT model, strategy, CAST(sum(n) AS BIGINT) AS n_sum, sum(tp) / sum(n) AS recall FROM counts GROUP BY ALL) c
        USING (model, strategy)""",
    "a14_scenario_matrix": "SELECT label, "
    + ", ".join(
        f"max({c}) FILTER (model = '{m}' AND strategy = '{s}') AS \"{m}/{s}_{c}\"" for _, m, s, _, _ in fx.RUNS for c in ("f1", "status")
    )
    + """, count(*) FILTER (f1 = 1) AS n_perfect FROM (SELECT *, CASE WHEN f1 = 1 THEN 'PERFECT' WHEN tp = 0 AND pp > 0 THEN 'ALL FP'
        WHEN f1 < 0.6 THEN 'NEAR FAIL' ELSE '' END AS status FROM classes) GROUP BY label""",
    "w1_rank_runs": """SELECT CAST(row_number() OVER (ORDER BY f1 DESC, store_ord) AS INTEGER) AS rank, model, strategy, f1, n, n_correct FROM scored""",
    "w2_best_run": "SELECT model, strategy, f1, true AS is_best FROM scored ORDER BY f1 DESC, store_ord LIMIT 1",
    "w3_best_per_model": "SELECT model, strategy, f1, n FROM best",
    "w4_running_counters": "SELECT split, position, written, skipped FROM counters",
    "w5_balanced_schedule": f"""SELECT doc_id, pos, {at('pos')} AS label FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)""",
    "w5_schedule_range": f"""SELECT label, count(*) AS n, min(pos) AS first, max(pos) AS last FROM (
        SELECT pos, {at('pos')} AS label FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)) GROUP BY label""",
    "w6_seeded_shuffle": f"""SELECT doc_id, {at('doc_id')} AS label, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS place FROM documents""",
    "w7_mini_batches": """SELECT doc_id, lang, ord, ord // 4 AS batch, ord % 4 AS batch_pos
        FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents)""",
    "w8_first_rows": f"SELECT ex_id, log, code AS codes FROM {EXAMPLES} ORDER BY ex_id LIMIT 5",
    "w9_loss_progression": """SELECT *, round(loss - previous_loss, 6) AS loss_change FROM (SELECT run_id, step, loss,
        lag(loss) OVER (PARTITION BY run_id ORDER BY step) AS previous_loss FROM tparsed WHERE step IS NOT NULL)""",
    "w10_best_per_label": """SELECT label, model, strategy, f1, n FROM classes
        QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, model, strategy) = 1""",
    "u1_append_runs": """SELECT model, strategy, f1, n, CASE WHEN store_ord = 2 THEN 5 WHEN store_ord = 5 THEN 6 ELSE store_ord END AS store_ord
        FROM scored""",
    "u2_dropped_runs": "SELECT model, strategy FROM scored EXCEPT SELECT model, strategy FROM best",
    "f1_predict_batches": """SELECT doc_id, concat('["', p, '"]') AS output, false AS defaulted, p AS codes FROM (
        SELECT doc_id, CASE WHEN len(ph) > 0 THEN ph[1] ELSE 'language_en' END AS p FROM lng)""",
    "t1_follow_training": """SELECT run_id, max(step) AS last_step, arg_max(loss, step) AS last_loss, arg_max(epoch, step) AS last_epoch,
        count(*) AS n_points FROM tparsed WHERE step IS NOT NULL GROUP BY run_id""",
    "t1_loss_changes": """SELECT *, round(loss - previous_loss, 6) AS loss_change FROM (SELECT run_id, step, loss,
        lag(loss) OVER (PARTITION BY run_id ORDER BY step) AS previous_loss FROM tparsed WHERE step IS NOT NULL)""",
    "t2_incremental_scores": """SELECT model, strategy, f1, "precision", recall, exact_match, n, CAST(CASE WHEN model IN ('m0', 'm2')
        THEN 6 + row_number() OVER (PARTITION BY model IN ('m0', 'm2') ORDER BY model, strategy) - 1
        ELSE row_number() OVER (ORDER BY model, strategy) - 1 END AS BIGINT) AS store_ord FROM scored""",
    "t3_label_windows": """SELECT window_start, window_end, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
        time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type FROM events)
        WHERE window_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""",
    "t3_collapse_alarm": """SELECT run_id, period_start, period_start + INTERVAL 1 DAY AS period_end, count(*) AS n_windows,
        count(*) FILTER (share >= 0.5 AND n >= 4) AS n_collapsed, CAST(sum(n) AS BIGINT) AS n, round_even(max(share), 4) AS top_share FROM (
          SELECT run_id, date_trunc('day', w)::TIMESTAMP AS period_start, count(*) AS n, count(*) FILTER (event_type = 'view') / count(*) AS share
          FROM (SELECT user_id % 6 AS run_id, event_type, time_bucket(INTERVAL 4 HOUR, ts) AS w FROM events) GROUP BY run_id, w)
        WHERE period_start + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)
        GROUP BY run_id, period_start HAVING count(*) FILTER (share >= 0.5 AND n >= 4) >= 1""",
    "j8_family_delta": f"""SELECT r.family, r.model, r.store_ord, r.f1, b.f1 AS baseline_f1, r.recall, b.recall AS baseline_recall,
        {points('r.f1', 'b.f1')} AS f1_change, {points('r.recall', 'b.recall')} AS recall_change FROM (
          SELECT v.model, v.family, s.f1, s.recall, s.store_ord FROM scored s JOIN (VALUES (0, 'a', 'a'), (1, 'a-x', 'a-x'), (2, 'a-x-y', 'a-x'),
            (3, 'b-x', NULL), (4, 'a-xy', 'a'), (5, 'a-x-y-z', 'a-x')) v(store_ord, model, family) USING (store_ord)) r
        LEFT JOIN (SELECT CASE store_ord WHEN 0 THEN 'a' ELSE 'a-x' END AS family, f1, recall FROM scored WHERE store_ord IN (0, 1)) b USING (family)""",
    "j9_store_diff": """SELECT model, strategy, CASE store_ord WHEN 1 THEN 'removed' WHEN 5 THEN 'added' ELSE 'equal' END AS status,
        CAST(NULL AS VARCHAR) AS path, CAST(NULL AS DOUBLE) AS "before", CAST(NULL AS DOUBLE) AS "after" FROM scored WHERE store_ord <> 3
        UNION ALL SELECT model, strategy, 'changed', 'metrics.f1', f1, 2.0 FROM scored WHERE store_ord = 3
        UNION ALL SELECT model, strategy, 'changed', concat('per_class.normal.', field), value, NULL FROM (
          SELECT model, strategy, unnest(['f1', 'precision', 'recall', 'n']) AS field, unnest([f1, "precision", recall, CAST(n AS DOUBLE)]) AS value
          FROM classes WHERE run = 3 AND label = 'normal')""",
    "k1_write_counts": """SELECT kind, reason, count(*) AS n, any_value(CASE kind WHEN 'valid' THEN n_valid ELSE n_all - n_valid END) AS observed FROM (
        SELECT CASE WHEN reason IS NULL THEN 'valid' ELSE 'quarantined' END AS kind, reason FROM checked),
        (SELECT count(*) FILTER (reason IS NULL) AS n_valid, count(*) AS n_all FROM checked) GROUP BY kind, reason""",
    "k1_repeated_keys": f"""SELECT coalesce(text, '') AS log, {at('doc_id // 3')} AS codes,
        concat('["', {at('doc_id // 3')}, '"', CASE WHEN doc_id % 3 = 1 THEN ',{{"q":2}}' ELSE '' END, ']') AS items,
        CASE WHEN doc_id % 3 = 2 THEN concat('{{"q":', doc_id, '}}') END AS extra FROM documents""",
    "p11_flips": """SELECT model, strategy, label, CAST(sum(old) AS BIGINT) AS n_before, CAST(sum(1 - old) AS BIGINT) AS n_after,
        CAST(sum(CASE WHEN flip THEN 1 - old ELSE 0 END) AS BIGINT) AS gained, CAST(sum(CASE WHEN flip THEN old ELSE 0 END) AS BIGINT) AS lost
        FROM (SELECT model, strategy, was AS label, 1 AS old, was <> now AS flip FROM flips
          UNION ALL SELECT model, strategy, now, 0, was <> now FROM flips) GROUP BY ALL""",
}


def oracle_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in ORACLES.items()}
