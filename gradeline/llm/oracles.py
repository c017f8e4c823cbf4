"""The registered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import mixing, pii

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s
  FROM words
), entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT u AS doc_id, v AS other FROM edges
  UNION
  SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other
), least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.other, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.other, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_of l USING (doc_id)
"""


def mixture(max_repetition: float) -> str:
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
    greatest(1, ceil(coalesce(strlen(text), 0) / 4)::BIGINT) AS tokens
  FROM documents
), totals AS (SELECT key, sum(tokens)::BIGINT AS total FROM docs GROUP BY key),
ends AS (SELECT max(total)::DOUBLE AS largest, min(total)::DOUBLE AS smallest FROM totals),
bisected AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN pow(largest / smallest, 1 - (lo + hi) / 2) <= {max_repetition} THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN pow(largest / smallest, 1 - (lo + hi) / 2) <= {max_repetition} THEN (lo + hi) / 2 ELSE hi END
  FROM bisected, ends WHERE i < {mixing.STEPS}
), solved AS (SELECT round(hi, 9) AS exponent FROM bisected WHERE i = {mixing.STEPS}),
masses AS (SELECT sum(pow(total / largest, exponent)) AS mass FROM totals, ends, solved),
plan AS (
  SELECT key, total, exponent, round(pow(total / largest, exponent) / mass, 12) AS weight,
    round(largest * mass)::BIGINT AS spent
  FROM totals, ends, solved, masses
), quotas AS (
  SELECT *, round(weight * spent)::BIGINT AS quota, greatest(1, ceil(spent / {mixing.BLOCK_TOKENS})::BIGINT) AS blocks FROM plan
), copies AS (
  SELECT d.*, q.* EXCLUDE (key), unnest(range(0, greatest(ceil(quota / total)::BIGINT, 1))) AS epoch
  FROM docs d JOIN quotas q USING (key)
), walked AS (
  SELECT *, {number.format("'0:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')")} AS walk,
    {number.format("'0:block:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')")} AS turn
  FROM copies
), placed AS (
  SELECT *, epoch * total + sum(tokens) OVER (PARTITION BY key, epoch ORDER BY walk, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS pos
  FROM walked
), kept AS (SELECT *, ((pos::HUGEINT * blocks) // quota)::BIGINT AS block FROM placed WHERE pos < quota)
SELECT doc_id, source, tokens, epoch, block, row_number() OVER (PARTITION BY block ORDER BY turn, doc_id, epoch, key, tokens) - 1 AS slot,
  weight, exponent
FROM kept
"""


def _kind_sql(kind: pii.Kind) -> tuple[str, str]:
    """(pattern, SQL test of a match ``m``) of a kind for an engine without look-around."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN (len({digits}) - i) % 2 = 1"
        f" THEN (substr({digits}, i, 1)::INT * 2) // 10 + (substr({digits}, i, 1)::INT * 2) % 10 ELSE substr({digits}, i, 1)::INT END)) % 10 = 0"
    )
    plain = "replace(m, ' ', '')"
    turned = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    value = f"(CASE WHEN substr({turned}, i, 1) >= 'A' THEN ascii(substr({turned}, i, 1)) - 55 ELSE ascii(substr({turned}, i, 1)) - 48 END)"
    mod97 = (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, len({plain}) + 1), lambda i: {value}::BIGINT)),"
        f" lambda r, v: (r * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1"
    )
    return {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
               r"list_bool_and(list_transform(string_split(m, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"len({digits}) BETWEEN 13 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) BETWEEN 9 AND 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
                 f"len({plain}) BETWEEN 15 AND 34 AND {mod97}"),
        "ssn": (r"[0-9-]+", r"regexp_full_match(m, '(00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(0[1-9]|[1-9][0-9])"
                            r"-(000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})')"),
    }[kind.name]


def personal_data() -> str:
    """Spans of each kind in a table of its own, then listed by kind and start."""
    tables, order = [], {k.name: i for i, k in enumerate(pii.KINDS)}
    for kind in pii.KINDS:
        pattern, valid = _kind_sql(kind)
        score = (
            f"least(1.0, {kind.prior} + CASE WHEN regexp_matches(lower(right(b, {pii.NEAR}) || ' ' || left(a, {pii.NEAR})),"
            f" '\\b(?:{'|'.join(kind.context)})\\b') THEN 0.25 ELSE 0.0 END)"
        )
        tables.append(f"""
  SELECT doc_id, '{kind.name}' AS kind, {order[kind.name]} AS place, i, pos AS start, pos + len(m) AS stop, {score} AS score
  FROM (
    SELECT doc_id, i, ms[i] AS m, bs[i] AS b, bs[i + 1] AS a,
      list_sum(list_transform(range(1, i + 1), lambda k: len(bs[k])))::BIGINT
        + coalesce(list_sum(list_transform(range(1, i), lambda k: len(ms[k]))), 0)::BIGINT AS pos
    FROM (
      SELECT doc_id, ms, bs, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS bs FROM documents)
    )
  ) WHERE {valid}""")
    base = ", ".join(f"'{n}'" for n in pii.BASE)
    counts = ", ".join(f"coalesce(count_{k.name}, 0)::BIGINT AS n_{k.name}" for k in pii.KINDS)
    counted = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS count_{k.name}" for k in pii.KINDS)
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start)"
    return f"""
WITH found AS ({' UNION ALL '.join(tables)}
), good AS (SELECT * FROM found WHERE kind IN ({base}) OR score >= {pii.LEAST_SCORE}),
listed AS (
  SELECT doc_id, {counted}, {listed} FILTER (kind IN ({base})) AS base, {listed} AS spans,
    string_agg(printf('%.2f', score), ',' ORDER BY place, start) AS scores
  FROM good GROUP BY doc_id
)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN listed USING (doc_id)
"""


ARCHIVES = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept_id FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept_id THEN kept_id END AS refers_to
FROM kept
"""


TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = f"""
WITH found AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM found GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term), totals
), asked AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

SPELLING = rf"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(run, '{UPPER}', '{UPPER.lower()}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), steps AS (
  SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
), crc AS (SELECT list(c::BIGINT ORDER BY i) AS t FROM steps WHERE k = 8
), sums AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, length(b) // 2), lambda i: ('0x' || substr(b, 2 * i + 1, 2))::BIGINT)),
    lambda r, x: xor(r // 256, t[(xor(r % 256, x) + 1)::INT])), 4294967295::BIGINT) AS h
  FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM found), crc
), counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM sums GROUP BY 1
), words AS (SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, (list({{'other': other, 'n': other_n}} ORDER BY other_n DESC, encode(other)))[1] AS b FROM near GROUP BY word
), known AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN b.n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS here, 0 AS k FROM known
  UNION ALL
  SELECT c.word, f.form, k + 1 FROM chain c JOIN known f ON f.word = c.here WHERE f.form IS NOT NULL
)
SELECT word, n, n_near, form, form_n, root FROM known JOIN (SELECT word, max_by(here, k) AS root FROM chain GROUP BY word) USING (word)
"""
