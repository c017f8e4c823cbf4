"""Column helpers for text: everything here stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that str.strip() and \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

FENCE = "`" * 3


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def search_pattern(pattern: str) -> str:
    """A regex for ``rlike`` with case ignored, Unicode classes, and ``.`` stopping at newline only."""
    return "(?idU)" + pattern.replace(r"\s", WHITESPACE_CLASS)


def required_words(pattern: str) -> tuple[str, ...]:
    """Plain words that every match of ``pattern`` must contain.

    A pattern is read only as far as it is simple: letters, digits and blanks
    joined by ``\\s+``, ``\\s*``, ``.*`` and ``.?``. Reading stops at the first
    construct beyond that, so the answer may be short but never wrong.
    """
    words, word, rest = [], "", pattern
    if "|" in pattern:
        return ()
    while rest:
        joint = next((j for j in (r"\s+", r"\s*", ".*", ".?") if rest.startswith(j)), None)
        if joint:
            words.append(word)
            word, rest = "", rest[len(joint):]
        elif rest[0].isascii() and (rest[0].isalnum() or rest[0] in " _-"):
            if rest[1:2] and rest[1] in "?*+{":
                break
            word, rest = word + rest[0].lower(), rest[1:]
        else:
            break
    return tuple(sorted({w for w in [*words, word] if w}, key=lambda w: (-len(w), w)))


def fold_for_words(lowered: Column) -> Column:
    """Lower-cased text in which every character that matches i, k or s without case is that letter."""
    odd = ("\u017f", "\u0131", "\u0307")
    is_ascii = F.octet_length(lowered) == F.char_length(lowered)
    plain = is_ascii | ~(F.contains(lowered, F.lit(odd[0])) | F.contains(lowered, F.lit(odd[1])) | F.contains(lowered, F.lit(odd[2])))
    return F.when(plain, lowered).otherwise(F.translate(lowered, "".join(odd), "si"))


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mentions(text: str, folded: str, pattern: str) -> str:
    """SQL condition: does the column ``text`` match ``pattern`` anywhere, ignoring case?

    The cheap word tests on ``folded`` come first. They are necessary conditions, so the
    regex runs only on the few texts that hold all of its words.
    """
    words = [f"contains({folded}, {sql_text(word)})" for word in required_words(pattern)]
    return "(" + " AND ".join([*words, f"rlike({text}, {sql_text(search_pattern(pattern))})"]) + ")"


def strip_fence(text: Column) -> Column:
    """Drop a Markdown code fence, and the word ``json`` after it, around an answer."""
    trimmed = strip(text)
    inner = F.element_at(F.split(trimmed, FENCE, -1), 2)
    return F.when(trimmed.startswith(FENCE), strip(F.regexp_replace(inner, r"\Ajson", ""))).otherwise(trimmed)


def slug(name: Column, max_chars: int | None = None) -> Column:
    """Last path segment in lower case with dots and underscores as dashes, optionally cut."""
    short = F.translate(F.lower(F.element_at(F.split(name, "/", -1), -1)), "._", "--")
    return short if max_chars is None else F.substring(short, 1, max_chars)


def percent(value: Column) -> Column:
    """0.9083 as ``90.83%``."""
    return F.format_string("%.2f%%", value * 100)


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """numerator / denominator, 0 when nothing is there to divide by; ties round to even."""
    share = numerator.cast("double") / F.when(denominator != 0, denominator).cast("double")
    return F.coalesce(F.bround(share, digits), F.lit(0.0))


def json_string_list(items: Column) -> Column:
    """A list of strings as a JSON array with ``", "`` between the items."""
    plain = F.concat(F.lit('["'), F.array_join(items, '", "'), F.lit('"]'))
    special = F.rlike(F.array_join(items, ""), F.lit(r'[^ -~]|["\\]')) | F.exists(items, lambda x: x.isNull())
    quoted = F.concat(F.lit("["), F.array_join(F.transform(items, _json_string), ", "), F.lit("]"))
    return F.when(F.size(items) == 0, F.lit("[]")).when(special, quoted).otherwise(plain)


def _json_string(item: Column) -> Column:
    body = F.to_json(F.struct(item.alias("v")), {"writeNonAsciiCharacterAsCodePoint": "true"})
    return F.when(item.isNull(), F.lit("null")).otherwise(F.substring(body, 6, F.length(body) - 6))
