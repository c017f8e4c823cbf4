"""Quality rules by compression.

The zstandard ratio (bytes of text over compressed bytes) of prose in an alphabet lies in a narrow band that rises slowly with the
length: 1.7 to 2.0 for a thousand bytes, 2.1 to 2.3 for four thousand. Text that repeats itself, or whose words carry the same symbols over and
over, lies above the band, and random text below it. The whole document is held against the band of its length, in
steps of an eighth of an octave. Fixed chunks are held against a wider band of theirs, so that a document with a repetitive or
random part is found although the whole still lies within its band; one chunk outside is enough. Scripts with several bytes a character
compress otherwise and have wider bands of their own: a text belongs to them if more than ``most_beyond`` of its bytes are not ASCII.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame

from .common import WordHashes, per_row, shingles

SYMBOLS = "#*$%&|<>"
ASCII = bytes(range(128))
SPACES = " \t\n\x0b\x0c\r"


Limits = tuple[tuple[int, float, float], ...]


def in_steps(knots: Limits, per_octave: int = 8) -> Limits:
    """(bytes from, least ratio, greatest ratio) in even steps of the logarithm of the length, by straight lines between the knots."""
    n, least, most = zip(*knots)
    at = np.arange(math.floor(math.log2(n[0]) * per_octave), math.ceil(math.log2(n[-1]) * per_octave) + 1) / per_octave
    middle = at + 0.5 / per_octave
    low, high = (np.interp(middle, np.log2(n), y) for y in (least, most))
    return ((0, 0.0, 4.0), *((math.ceil(2**x), round(float(a), 4), round(float(b), 4)) for x, a, b in zip(at, low, high)))


#: Bands of whole texts in alphabets, chosen on labelled documents with an even id; see the README.
PROSE = (
    (256, 1.28, 1.68),
    (384, 1.25, 1.80),
    (512, 1.30, 1.845),
    (768, 1.45, 1.90),
    (1024, 1.54, 1.985),
    (1536, 1.67, 2.063),
    (2048, 1.75, 2.118),
    (3072, 1.86, 2.192),
    (4096, 1.93, 2.244),
    (6144, 1.99, 2.318),
    (8192, 2.03, 2.36),
    (16384, 2.10, 2.47),
    (65536, 2.15, 2.68),
    (1 << 20, 2.15, 3.0),
)


@dataclass(frozen=True)
class Bands:
    """Limits are (bytes from, least ratio, greatest ratio), ascending. Of the chunks of ``chunk`` bytes ``bad_share`` may fail."""

    limits: Limits = in_steps(PROSE)
    chunk_limits: Limits = ((0, 0.0, 4.0), (256, 1.05, 3.5), (512, 1.25, 3.0), (1024, 1.42, 2.7))
    other_limits: Limits = ((0, 0.0, 4.0), (256, 1.05, 4.0), (1024, 1.4, 4.5), (4096, 1.45, 5.5), (16384, 1.45, 7.0), (65536, 1.45, 8.0))
    other_chunk_limits: Limits = ((0, 0.0, 4.5), (256, 1.05, 4.5), (1024, 1.3, 4.5))
    most_beyond: float = 0.3
    level: int = 3
    chunk: int = 1024
    bad_share: float = 0.0

    def of(self, data: bytes) -> tuple[Limits, Limits]:
        """The limits of a text and of its chunks."""
        if len(data.translate(None, ASCII)) > self.most_beyond * len(data):
            return self.other_limits, self.other_chunk_limits
        return self.limits, self.chunk_limits


def holds(limits: Limits, n_bytes: int, ratio: float) -> bool:
    _, least, most = limits[bisect.bisect_right(limits, n_bytes, key=lambda x: x[0]) - 1]
    return least <= ratio <= most


BANDS = Bands()

RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("ratio", pa.float64()),
    ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()), ("verdict", pa.string()), ("kept", pa.bool_()),
])


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    if len(hashes) < 4:
        return 0
    _, inverse, count = np.unique(shingles(hashes, 3), return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k : len(twice) + k] |= twice
    return int(covered.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _measure(bands: Bands):
    def make():
        hashes, compressor = WordHashes(), zstandard.ZstdCompressor(level=bands.level)

        def ratio_of(data):
            return len(data) / len(compressor.compress(data)) if len(data) else 0.0

        def of_row(doc_id, text):
            text = text or ""
            data = text.encode()
            tokens = data.split()
            repeats = repeated_words(hashes.of(tokens))
            failed = len(tokens) < 50 or 100 * repeats > 50 * len(tokens)
            ratio, chunks, bad = ratio_of(data), 0, 0
            limits, chunk_limits = bands.of(data)
            if len(data) > bands.chunk:
                whole = memoryview(data)
                parts = [whole[i : i + bands.chunk] for i in range(0, len(data), bands.chunk)]
                chunks = len(parts)
                bad = sum(not holds(chunk_limits, len(p), ratio_of(p)) for p in parts)
            if failed:
                verdict = "base"
            elif not holds(limits, len(data), ratio):
                verdict = "whole"
            elif bad > bands.bad_share * chunks:
                verdict = "chunks"
            else:
                verdict = "kept"
            return (
                doc_id, len(tokens), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
                duplicate_lines(data), repeats, failed, ratio, chunks, bad, verdict, verdict == "kept",
            )

        return of_row

    return per_row(make, RESULT)


def compression_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = BANDS) -> DataFrame:
    """Counts, compression ratio and verdict of every row of ``docs``, in one pass without a shuffle.

    ``verdict`` is ``base`` (fewer than 50 words, or more than half of them in repeated 3-word windows),
    ``whole`` (the ratio of the text lies outside the band of its length), ``chunks`` (more than
    ``bands.bad_share`` of its chunks lie outside theirs) or ``kept``. A null text counts as an empty
    one, has ratio 0 and fails the base rules. A null id stays null, repeated rows give repeated
    results, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(
        _measure(bands),
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
        " base_failed boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, verdict string, kept boolean",
    )


def drop_rejected(docs: DataFrame, text_col: str = "text", bands: Bands = BANDS) -> DataFrame:
    """``docs`` without the documents that :func:`compression_quality` rejects; all columns stay as they are."""
    measured = None

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        nonlocal measured
        if measured is None:
            measured = _measure(bands)
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"])
        return pa.concat_arrays([out.column("kept") for out in measured(iter([batch]))] or [pa.array([], pa.bool_())])

    return docs.filter(passes(F.col(text_col).cast("string")))
