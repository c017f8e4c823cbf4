"""Spelling variants by finite-state composition.

Near words, one inserted, deleted or replaced code point apart, are what the composition *vocabulary acceptor ∘ one-edit transducer ∘
vocabulary acceptor* accepts. The composed machine is enumerated in parts, each with an initial state of its own: the state that the acceptor has
reached after a given beginning. Of two near words, the shorter one of m code points, the first m // 2 code points are the same, or else the
last m - m // 2 are; in the second case the words are read backwards. So a word goes to the parts of its beginning and of its end, once as the
shorter word of a pair and once as the longer one, and every pair is accepted in exactly one part:

1. The tails of the words of a part are put into a minimal acceptor. Its states know how many words they accept, so that
   a path adds up to the number of its word and no strings are built on the way.
2. The composition is lazy: states are (state of the one word, state of the other, state of the transducer), walked on a stack of its own.
3. A part hands out what its pairs add up to for each word: how many there are, and the most frequent partner.

A part with more than ``PART_WORDS`` words is dealt out, and each two of its shares make a machine, so no task holds more than two shares.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

RUNS = "[A-Za-zÀ-ÿ]"
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Counts are handed on when so many different words are held.
HELD_WORDS = 200_000
PART_WORDS = 20_000
#: Where a code point is left out: the divisor of the check sum.
SLIP = 199

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def slipped(doc_id: int | None, run: str) -> str:
    """The run, without one code point if the check sum of its place says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def _count_words(least_length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"{RUNS}{{{least_length},}}")
        counts: Counter[str] = Counter()

        def handed_on():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=COUNTS)
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own: Counter[str] = Counter()
                for found, n in Counter(runs.findall(text or "")).items():
                    own[found.lower() if found.isascii() else found.translate(UPPER)] += n
                for word, n in own.items():
                    word = slipped(doc_id, word)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield handed_on()
        yield handed_on()

    return run


class Acceptor:
    """The minimal acyclic acceptor of ascending, distinct words; words are numbered in their order."""

    def __init__(self, words: list[str]) -> None:
        self.final: list[bool] = []
        self.size: list[int] = []  # accepted words from a state
        self.moves: list[dict[str, tuple[int, int]]] = []  # letter -> (state, accepted words passed over)
        self._known: dict[tuple, int] = {}
        path: list[tuple[str, list, bool]] = []  # open states below the start: (letter to it, moves so far, final)
        start: list = []
        start_final, before = False, ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            self._close(path, start, shared)
            path += [(letter, [], k == len(word) - 1) for k, letter in enumerate(word[shared:], shared)]
            start_final |= not word
            before = word
        self._close(path, start, 0)
        self.start = self._state(start_final, start)

    def _close(self, path: list, start: list, depth: int) -> None:
        while len(path) > depth:
            letter, moves, final = path.pop()
            (path[-1][1] if path else start).append((letter, self._state(final, moves)))

    def _state(self, final: bool, moves: list[tuple[str, int]]) -> int:
        key = (final, *moves)
        if key not in self._known:
            passed, out = int(final), {}
            for letter, state in moves:
                out[letter] = (state, passed)
                passed += self.size[state]
            self._known[key] = len(self.size)
            self.final.append(final)
            self.size.append(passed)
            self.moves.append(out)
        return self._known[key]


def one_edit_pairs(machine: Acceptor) -> Iterator[tuple[int, int]]:
    """Numbers of all pairs of accepted words that are one edit apart, each pair once.

    The transducer has the states *equal so far* and *edited*, and a third for the letter after an insertion, which
    must not be the inserted one: of the places that give the same longer word only the last one counts.
    """
    final, moves = machine.final, machine.moves
    stack = [(machine.start, machine.start, False, "", 0, 0)]
    while stack:
        p, q, edited, barred, u, v = stack.pop()
        left, right = moves[p], moves[q]
        if edited:
            if final[p] and final[q]:
                yield u, v
            if len(right) < len(left):
                common = [c for c in right if c in left]
            else:
                common = [c for c in left if c in right]
            for c in common:
                if c != barred:
                    (p1, du), (q1, dv) = left[c], right[c]
                    stack.append((p1, q1, True, "", u + du, v + dv))
            continue
        for c, (q1, dv) in right.items():
            stack.append((q1, q1, False, "", u + dv, v + dv))  # the same word so far, so the same state
            stack.append((p, q1, True, c, u, v + dv))  # inserted
            for b, (p1, du) in left.items():
                if b < c:
                    stack.append((p1, q1, True, "", u + du, v + dv))  # replaced


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_in_part(backwards: bool, m: int, shares: list[int], words: list[str], counts: list[int]) -> dict[int, tuple[int, int, str]]:
    """Position of a word -> (near words, occurrences of the most frequent one, that word), for the pairs that this part has to find."""
    head = m // 2
    tails = [w[: len(w) - (m - head)][::-1] if backwards else w[head:] for w in words]
    order = sorted(range(len(words)), key=tails.__getitem__)
    across, found = len(set(shares)) > 1, {}
    for a, b in one_edit_pairs(Acceptor([tails[k] for k in order])):
        i, j = order[a], order[b]
        if min(len(words[i]), len(words[j])) != m or across and shares[i] == shares[j]:
            continue
        if backwards and words[i][:head] == words[j][:head]:
            continue
        for x, y in ((i, j), (j, i)):
            n_near, n, best = found.get(x, (0, 0, ""))
            n, best = min((n, best), (counts[y], words[y]), key=lambda c: (-c[0], c[1])) if n_near else (counts[y], words[y])
            found[x] = n_near + 1, n, best
    return found


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (part, i, j, m, backwards, share, word, n) sorted by part, i and j. Holds one part, or two shares of one, at a time."""
    open_part, held, done = None, [], []

    def closed():
        if len(held) > 1:
            _, _, _, m, backwards, shares, words, counts = zip(*held)
            found = near_in_part(backwards[0], m[0], list(shares), list(words), list(counts))
            done.extend((words[k], *values) for k, values in found.items())

    def handed_on():
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(NEAR)], schema=NEAR)
        done.clear()
        return out

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != open_part:
                closed()
                open_part, held = row[:3], []
            held.append(row)
        if len(done) >= 5000:
            yield handed_on()
    closed()
    yield handed_on()


def near_words(vocabulary: DataFrame, least_length: int = 6) -> DataFrame:
    """(word, n_near, best_n, best) for each word of (word, n) that has a near word; ``best`` is the most frequent, then the first of them."""
    length = F.char_length("word")
    pairs = F.explode(F.filter(F.array(length, length - 1), lambda m: m >= least_length)).alias("m")
    head = F.expr("m div 2").cast("int")
    beginning = F.struct(F.lit(False).alias("backwards"), F.substring("word", F.lit(1), head).alias("key"))
    end = F.struct(F.lit(True).alias("backwards"), F.right("word", F.col("m") - head).alias("key"))
    rows = vocabulary.select("word", "n", pairs).select("word", "n", "m", F.explode(F.array(beginning, end)).alias("at"))
    rows = rows.select("word", "n", "m", "at.backwards", F.concat_ws(":", F.col("at.backwards").cast("int"), "m", "at.key").alias("part"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = stage(sizes.select("part", F.ceil(F.col("size") / PART_WORDS).cast("bigint").alias("shares")), "parts")
    dealt = rows.join(sizes, "part").withColumn("share", F.pmod(F.xxhash64("word"), "shares"))
    # Every two shares of a part meet once; a share alone makes its own machine as well.
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("other")
    dealt = dealt.select("*", other).select(
        "part", F.least("share", "other").alias("i"), F.greatest("share", "other").alias("j"), "m", "backwards", "share", "word", "n"
    )
    near = dealt.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(
        _compose, "word string, n_near bigint, best_n bigint, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best"))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form). Each round doubles the steps taken, and a chain ends as its counts grow by a factor at every step."""
    reached = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return reached


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, factor: int = 5,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``docs`` with at least ``least_length`` code points and ``least_n`` occurrences.

    Words are maximal runs of Latin letters with A-Z lower-cased; every 199th by check sum of id and run loses a code point.
    ``form`` is the most frequent near word if that has at least ``factor`` times the occurrences, ``root`` the last form that is reached from there.

    Null and empty texts have no words. A null id counts as an empty text in the check sum. Repeated rows count again. Of near words with
    the same count the first in code-point order is the form. Words of any length are taken. An empty table gives an empty one. Other columns
    are not read.
    """
    if least_length < 2 or factor < 2:
        raise ValueError("least_length and factor: 2 at least")
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    with small_batches(docs.sparkSession):
        counted = rows.mapInArrow(_count_words(least_length), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        vocabulary = stage(counted.filter(F.col("n") >= least_n), "vocabulary")
    near = near_words(vocabulary, least_length)
    enough = F.col("best_n") >= factor * F.col("n")
    known = stage(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"),
    ), "variants")
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
