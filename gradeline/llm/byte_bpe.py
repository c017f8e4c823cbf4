"""Byte-level BPE encoding and decoding with the tokenizers library.

Every byte of a text stands for one character of a fixed alphabet of 256 printable characters. The
library's BPE model runs on those characters; token offsets are then byte offsets, which are mapped
to code points. A token may hold part of a character only; it spans that whole character.
Decoding turns the characters of the tokens back into bytes and only then into text, so that
characters that are split over tokens come out whole.

The merges are derived from the ranks: the parts of a token are what lower ranks merge its bytes to.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame
from tokenizers import models

CACHED_PIECES = 100_000


def byte_alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two parts that are left when all merges of a lower rank than the token's have been made."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
        if rank >= ranks[token]:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteBpe:
    """Encoder and decoder; pieces that were met before are remembered up to a bound."""

    def __init__(self, path: str, pattern: str):
        self.alphabet = byte_alphabet()
        self.to_characters = dict(enumerate(self.alphabet))
        self.pieces = regex.compile(pattern)
        ranks = read_ranks(path)
        spell = self.spell
        merges = []
        for token in sorted(ranks, key=ranks.get):
            parts = merge_parts(token, ranks)
            if len(parts) == 2:
                merges.append((spell(parts[0]), spell(parts[1])))
        vocab = {spell(token): rank for token, rank in ranks.items()}
        self.model = models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0)
        to_byte = {c: b for b, c in enumerate(self.alphabet)}
        self.bytes_of = {rank: bytes(to_byte[c] for c in word) for word, rank in vocab.items()}
        self.sizes = np.zeros(max(vocab.values(), default=-1) + 1, np.int32)
        for rank, token in self.bytes_of.items():
            self.sizes[rank] = len(token)
        self.names = {rank: str(rank) for rank in vocab.values()}
        self.known: dict[str, tuple[int, ...]] = {}

    def spell(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.to_characters)

    def piece(self, piece: str) -> tuple[int, ...]:
        return tuple(token.id for token in self.model.tokenize(self.spell(piece.encode())))

    def encode(self, text: str) -> list[int]:
        known, pieces = self.known, self.pieces.findall(text)
        if len(known) > CACHED_PIECES:
            known.clear()
        for new in set(pieces).difference(known):
            known[new] = self.piece(new)
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> tuple[bytes, str]:
        """The bytes, and the text with U+FFFD for what is not UTF-8."""
        data = self.decode_bytes(ids)
        return data, data.decode("utf-8", "replace")

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every token in code points; a token with part of a character spans all of it."""
        lead = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        begun = np.zeros(len(lead) + 1, np.int32)
        np.cumsum(lead, out=begun[1:])
        sizes = self.sizes[np.array(ids, np.int32)]
        ends = np.cumsum(sizes, dtype=np.int64)
        first = begun[np.minimum(ends - sizes + 1, len(lead))] - 1
        return first, begun[ends]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One encoder per Python worker."""
    return ByteBpe(path, pattern)


def _with(path: str, pattern: str, schema: pa.Schema, values: Callable[[ByteBpe, tuple], tuple], rows: int = 64) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = zip(*(values(bpe, row) for row in zip(*(c.to_pylist() for c in part.columns))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
        # the worker serves other jobs after this task
        bpe.known.clear()
        pa.default_memory_pool().release_unused()

    return run


def _rows(df: DataFrame, id_col: str, value_col: str, kind: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint"), F.col(value_col).cast(kind))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded_sha256) of every row: token ids, the code points that each token covers, and
    a digest of the text that the ids decode to.

    A null text counts as an empty one and has no tokens. Null ids stay, repeated rows give repeated
    results, other columns are not read. Special tokens are ordinary text.
    """
    ints = pa.list_(pa.int32())

    def values(bpe, row):
        text = row[1] or ""
        ids = bpe.encode(text)
        decoded = hashlib.sha256(bpe.decode(ids)[1].encode()).hexdigest()
        return row[0], np.array(ids, np.int32), *bpe.offsets(text, ids), decoded

    schema = pa.schema([("doc_id", pa.int64()), ("ids", ints), ("starts", ints), ("ends", ints), ("decoded_sha256", pa.string())])
    return _rows(docs, id_col, text_col, "string").mapInArrow(
        _with(path, pattern, schema, values),
        "doc_id bigint, ids array<int>, starts array<int>, ends array<int>, decoded_sha256 string",
    )


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data, text) of every row of token ids: the bytes, and the text with U+FFFD for what is not UTF-8.

    A null list counts as an empty one. An id outside the vocabulary is an error.
    """

    def values(bpe, row):
        return row[0], *bpe.decode(row[1] or [])

    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary()), ("text", pa.string())])
    return _rows(tokens, id_col, ids_col, "array<int>").mapInArrow(
        _with(path, pattern, schema, values), "doc_id bigint, data binary, text string"
    )


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded to text again in one pass.

    Only digests leave the worker. Nulls and repeated rows as in :func:`encode`.
    """

    def values(bpe, row):
        ids = bpe.encode(row[1] or "")
        listed = " ".join(map(bpe.names.__getitem__, ids)).encode()
        return row[0], len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(bpe.decode(ids)[1].encode()).hexdigest()

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
    ])
    return _rows(docs, id_col, text_col, "string").mapInArrow(
        _with(path, pattern, schema, values), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
