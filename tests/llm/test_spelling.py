"""Spelling variants by composed acceptors against plain code."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.awkward import ROWS, UPPER, awkward_documents, rows_of

from gradeline.llm import spelling

CLASHES = ["word", "n", "m", "part", "share", "root", "form", "a.b"]


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    out = []
    for word, n in counts.items():
        close = sorted((-counts[o], o) for o in counts if near(word, o))
        form = close[0][1] if close and -close[0][0] >= 5 * n else None
        out.append([word, n, len(close), form, counts[form] if form else None, word])
    forms = {r[0]: r[3] for r in out}
    for r in out:
        while forms[r[5]]:
            r[5] = forms[r[5]]
    return sorted(map(tuple, out), key=str)


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def result(df):
    return sorted(((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows_of(df)), key=str)


def texts():
    """Words and misspellings of them, in mixed case, some with a letter that has no ASCII, one of 3,000 letters."""
    rng = random.Random(2)
    letters = "abcdeéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 11))) for _ in range(8)] + ["ab" * 1500, "aaaaaa", "aaaaaaa", "Äbcdefg"]
    out = []
    for k in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(base)
            while rng.random() < 0.2:  # at one of two places, so that the same slips come again
                at, what = rng.choice([1, 4]), rng.random()
                w = w[:at] + (w[at + 1 :] if what < 0.5 else "e" + w[at + (what < 0.8) :])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((k, rng.choice([" ", "-", "1", "语"]).join(words)))
    out.append((1000, "chained " * 300 + "chainedd " * 50 + "chaineddd " * 8))
    return out + ROWS


def test_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    want = plain_variants(plain_counts(rows))
    assert result(spelling.spelling_variants(docs)) == want
    assert sum(r[3] is not None for r in want) > 20 and any(r[5] not in (r[0], r[3]) for r in want)


def test_awkward_rows_and_clashing_columns(spark):
    docs = awkward_documents(spark, CLASHES)
    assert result(spelling.spelling_variants(docs)) == plain_variants(plain_counts(ROWS))
    empty = spelling.spelling_variants(docs.limit(0))
    assert empty.columns == ["word", "n", "n_near", "form", "form_n", "root"] and empty.count() == 0


def test_parts_that_are_dealt_out(spark, monkeypatch):
    """A beginning that many words share, in shares of five words."""
    monkeypatch.setattr(spelling, "PART_WORDS", 5)
    rng = random.Random(8)
    counts = {"hot" + "".join(rng.choice("abc") for _ in range(rng.choice([3, 4, 4, 5]))): rng.randrange(5, 900) for _ in range(150)}
    found = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    want = {}
    for word in counts:
        close = sorted((-counts[o], o) for o in counts if near(word, o))
        if close:
            want[word] = (len(close), -close[0][0], close[0][1])
    assert {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in rows_of(found)} == want


@settings(deadline=None, max_examples=200)
@given(st.sets(st.text("abc", max_size=6), max_size=40))
def test_acceptor_is_minimal_and_pairs_are_exact(words):
    words = sorted(words)
    machine = spelling.Acceptor(words)
    numbers, rights = {}, {}

    def walk(state, prefix, number):
        tails = {""} if machine.final[state] else set()
        if machine.final[state]:
            numbers[prefix] = number
        for c, (to, passed) in machine.moves[state].items():
            tails |= {c + t for t in walk(to, prefix + c, number + passed)}
        rights.setdefault(state, frozenset(tails))
        return tails

    walk(machine.start, "", 0)
    assert numbers == {w: k for k, w in enumerate(words)}
    assert len(set(rights.values())) == len(rights)  # no two states accept the same
    pairs = [tuple(sorted(p)) for p in spelling.one_edit_pairs(machine)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for i, j in combinations(range(len(words)), 2) if near(words[i], words[j])}


@settings(deadline=None, max_examples=200)
@given(st.sets(st.text("abé", min_size=2, max_size=7), max_size=40))
def test_every_pair_has_one_part(words):
    parts = {}
    for w in words:
        for m in (len(w), len(w) - 1):
            if m >= 2:
                parts.setdefault((False, m, w[: m // 2]), []).append(w)
                parts.setdefault((True, m, w[len(w) - (m - m // 2) :]), []).append(w)
    found = Counter()
    for (backwards, m, _), members in parts.items():
        for k, (n, _, _) in spelling.near_in_part(backwards, m, [0] * len(members), members, [1] * len(members)).items():
            found[members[k]] += n
    assert found == Counter({w: n for w in words if (n := sum(near(w, o) for o in words))})


def test_arguments(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(awkward_documents(spark), factor=1)
