"""Personal data by regular expressions, checksums and context, in DataFrame expressions only.

A pattern proposes spans; a validator confirms them (part sizes of addresses, the Luhn sum of
card numbers, mod 97 of IBANs, digit counts of phone numbers); words near a span adjust its score.
The four base kinds are always returned; the kinds beyond them need a score of ``LEAST_SCORE``.

Spark gives the matches of a pattern and the text between them; their lengths, added up, are the
positions. The patterns are written so that no text makes them backtrack or recurse: repetitions
are possessive, and a match is begun only where the run before it ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR = 40
LEAST_SCORE = 0.6
#: Matches that are added up, and spans that are cut out, in one go; a matter of speed only.
RUN = 256
LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """``gate`` is a plain test that every text with a match passes; ``valid`` is SQL over a match ``m``."""

    name: str
    pattern: str
    gate: str
    valid: str
    prior: float
    context: tuple[str, ...]
    base: bool = True


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    digit = f"cast(substr({d}, i, 1) AS int)"
    double = f"(length({d}) - i) % 2 = 1"
    return (
        f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + if({double}, {digit} * 2 - if({digit} > 4, 9, 0), {digit}))"
        " % 10 = 0"
    )


def _mod97(m: str) -> str:
    plain = f"replace({m}, ' ', '')"
    turned = f"concat(substr({plain}, 5), substr({plain}, 1, 4))"
    char = f"substr({turned}, i, 1)"
    return (
        f"aggregate(sequence(1, length({plain})), 0, (r, i) -> if({char} >= 'A', (r * 100 + ascii({char}) - 55) % 97,"
        f" (r * 10 + cast({char} AS int)) % 97)) = 1"
    )


BYTE = "0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
KINDS = (
    Kind(
        "email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true",
        0.8, ("email", "emails", "e-mail", "mailto", "contact", "kontakt", "correo", "courriel"),
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "contains(t, '.')",
        f"m RLIKE r'^{BYTE}([.]{BYTE}){{3}}$'",
        0.7, ("ip", "address", "adresse", "host", "server", "client", "login"),
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9]){12,}+", "t RLIKE '[0-9]'",
        f"length({_digits('m')}) BETWEEN 13 AND 19 AND {_luhn(_digits('m'))}",
        0.7, ("card", "karte", "kreditkarte", "carte", "tarjeta", "visa", "mastercard", "amex", "cvv"),
    ),
    Kind(
        "phone", r"\+[0-9](?:[\x20().-]*+[0-9])++", "contains(t, '+')", f"length({_digits('m')}) BETWEEN 9 AND 15",
        0.6, ("phone", "tel", "telefon", "mobile", "mobil", "call", "fax"),
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
        "t RLIKE '[A-Z]{2}[0-9]{2}'", f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {_mod97('m')}",
        0.7, ("iban", "bank", "konto", "account", "cuenta", "compte"), base=False,
    ),
    Kind(
        "ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "contains(t, '-')", "true",
        0.4, ("ssn", "social security"), base=False,
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def _spans(kind: Kind) -> str:
    """SQL for the confirmed spans of a kind, from the matches ``m_<kind>`` and the texts between them, ``b_<kind>``."""
    m, before, after = f"element_at(m_{kind.name}, k)", f"element_at(b_{kind.name}, k)", f"element_at(b_{kind.name}, k + 1)"
    words = f"(?<![a-z0-9_])(?:{'|'.join(kind.context)})(?![a-z0-9_])"
    nearby = f"lower(concat(right({before}, {NEAR}), ' ', left({after}, {NEAR}))) RLIKE {_quoted(words)}"
    score = f"least(1.0D, {kind.prior}D + if({nearby}, 0.25D, 0.0D))"
    start = f"element_at(s_{kind.name}, k)"
    span = f"named_struct('start', {start}, 'end', {start} + length({m}), 'kind', '{kind.name}', 'score', {score})"
    valid = kind.valid.replace("(m,", f"({m},").replace("m RLIKE", f"{m} RLIKE")
    none = "cast(array() AS array<struct<start:int,end:int,kind:string,score:double>>)"
    found = f"transform(filter(sequence(1, size(m_{kind.name})), k -> {valid}), k -> {span})"
    if not kind.base:
        found = f"filter({found}, x -> x.score >= {LEAST_SCORE})"
    return f"if(size(m_{kind.name}) > 0, {found}, {none})"


def _starts(name: str) -> str:
    """SQL for the positions where the matches of a kind begin.

    Blocks of ``RUN`` matches are added up first, then the positions inside each of them: an array that grows by one element
    at a time is copied at every step, so none may get long.
    """
    before, match = f"element_at(b_{name}, k)", f"element_at(m_{name}, k)"
    n, none = f"size(m_{name})", "cast(array() AS array<int>)"
    ks = f"sequence(r * {RUN} + 1, least({n}, (r + 1) * {RUN}))"
    moved = f"aggregate({ks}, 0, (s, k) -> s + length({before}) + length({match}))"
    firsts = (
        f"aggregate(sequence(0, cast(({n} - 1) div {RUN} AS int)), named_struct('at', 0, 'to', {none}),"
        f" (a, r) -> named_struct('at', a.at + {moved}, 'to', concat(a.to, array(a.at))), a -> a.to)"
    )
    inside = (
        f"aggregate({ks}, named_struct('at', x, 'to', {none}), (a, k) -> named_struct('at', a.at + length({before}) + length({match}),"
        f" 'to', concat(a.to, array(a.at + length({before})))), a -> a.to)"
    )
    return f"if({n} > 0, flatten(transform({firsts}, (x, r) -> {inside})), {none})"


def find_spans(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with a column ``out``: a struct with one array of (start, end, kind, score) per kind.

    Positions are code points, the end exclusive. Spans of one kind are the leftmost non-overlapping
    matches, in order; those that fail their validator are left out and not tried again.
    A null text counts as an empty one. Other columns keep their names; names that begin with
    ``__pii`` are taken.
    """
    inner = df.select(F.struct("*").alias("__pii_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    none = "cast(array() AS array<string>)"
    inner = inner.select("*", *(
        F.expr(f"if({k.gate}, regexp_extract_all(t, {_quoted(k.pattern)}, 0), {none})").alias(f"m_{k.name}") for k in KINDS
    ))
    inner = inner.select("*", *(
        F.expr(f"if(size(m_{k.name}) > 0, split(t, {_quoted(k.pattern)}, -1), {none})").alias(f"b_{k.name}") for k in KINDS
    ))
    inner = inner.select("*", *(F.expr(_starts(k.name)).alias(f"s_{k.name}") for k in KINDS))
    spans = F.struct(*(F.expr(_spans(k)).alias(k.name) for k in KINDS))
    inner = inner.select("__pii_row", spans.alias("__pii_spans"))
    return inner.select("__pii_row.*", F.col("__pii_spans").alias(out))


def _listed(spans: str, names: tuple[str, ...], form: str) -> str:
    arrays = ", ".join(f"{spans}.{n}" for n in names)
    return f"array_join(transform(concat({arrays}), x -> {form}), ',')"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every row, in one pass without a shuffle and without Python workers.

    Columns: doc_id, n_<kind> for every kind, ``base_sha256`` of the base spans listed as
    ``kind:start:end`` by kind and start, ``spans`` with all spans listed in the same way, and ``scores``
    in the order of ``spans``. Null texts have no spans, null ids stay, repeated rows give repeated
    results, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = find_spans(rows, "text", "found")
    place = "concat(x.kind, ':', x.start, ':', x.end)"
    every = tuple(k.name for k in KINDS)
    return found.select(
        "doc_id",
        *(F.size(f"found.{n}").cast("bigint").alias(f"n_{n}") for n in every),
        F.expr(f"sha2({_listed('found', BASE, place)}, 256)").alias("base_sha256"),
        F.expr(_listed("found", every, place)).alias("spans"),
        F.expr(_listed("found", every, "format_number(x.score, '0.00')")).alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    Texts without spans and null texts stay as they are, and so do all other columns.
    """
    found = find_spans(docs, text_col, "__pii_found")
    arrays = ", ".join(f"__pii_found.{k.name}" for k in KINDS)
    found = found.withColumn("__pii_all", F.expr(f"array_sort(concat({arrays}))")).drop("__pii_found")
    text = f"`{text_col}`"
    some = f"slice(__pii_all, r * {RUN} + 1, {RUN})"
    reach = "(s, x) -> greatest(s, x.end)"
    # The text is cut into pieces of RUN spans first, and a piece at its spans: no cut counts its way from the start of a long text.
    pieces = (
        f"aggregate(sequence(0, cast((size(__pii_all) - 1) div {RUN} AS int)), named_struct('at', 0, 'to', cast(array() AS array<struct<b:int,e:int>>)),"
        f" (a, r) -> named_struct('at', aggregate({some}, a.at, {reach}),"
        f" 'to', concat(a.to, array(named_struct('b', a.at, 'e', aggregate({some}, a.at, {reach}))))), a -> a.to)"
    )
    masked_piece = (
        f"aggregate({some}, named_struct('at', p.b, 'parts', cast(array() AS array<string>), 'piece', substr({text}, p.b + 1, p.e - p.b)),"
        f" (a, x) -> named_struct('at', greatest(a.at, x.end), 'parts', if(x.start >= a.at,"
        f" concat(a.parts, array(substr(a.piece, a.at - p.b + 1, x.start - a.at), concat('[', upper(x.kind), ']'))), a.parts), 'piece', a.piece),"
        f" a -> array_join(a.parts, ''))"
    )
    masked = F.expr(
        f"concat(array_join(transform({pieces}, (p, r) -> {masked_piece}), ''), substr({text}, aggregate(__pii_all, 0, {reach}) + 1))"
    )
    changed = F.when(F.size("__pii_all") > 0, masked).otherwise(F.col(text_col))
    return found.withColumn(text_col, changed).drop("__pii_all")
