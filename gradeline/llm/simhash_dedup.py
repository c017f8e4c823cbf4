"""Near-duplicate documents by SimHash and bit-sliced comparison.

The fingerprint has 64 bits: a bit is set if more than half of the hashes of the shingles have it set.
Two fingerprints with at most ``radius`` different bits, cut in ``radius + 2`` parts, agree in two parts at least,
so a table for each pair of parts, keyed by both, finds every such pair. Only distinct fingerprints take part:

1. A fingerprint has an entry in every table; entries alone under their key go.
2. The entries of a key are a block, and small keys share one. A key with more than ``BLOCK`` fingerprints is dealt
   out, and each pair of its parts is a block. Blocks are bounded and are read as a sorted stream.
3. In a block, bit planes are stored vertically: one machine word holds one bit of 64 fingerprints. The exclusive
   or of a plane with a bit of a fingerprint is added to 64 distances at once, in a carry-save counter of bitwise
   operations that stays at its end beyond the radius. A fingerprint whose block lies beyond the radius as a
   whole is abandoned there.
4. A block returns a spanning forest of its links, fewer links than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_row, small_batches, stage, words
from .components import components

BITS = 64
#: Fingerprints of one side of a block.
BLOCK = 1024
#: Planes that are added up before abandoned rows are taken out.
PLANES = 8
AT_ONCE = 1 << 16
SEED = 42
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(tokens: list[bytes], width: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``width`` words, joined by spaces, in parts of bounded size; fewer words are one run."""
    if not tokens:
        return
    width = min(width, len(tokens))
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - width + 1]
    ends = ends[width - 1 :]
    for k in range(0, len(starts), AT_ONCE):
        spans = zip(starts[k : k + AT_ONCE].tolist(), ends[k : k + AT_ONCE].tolist())
        yield np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def simhash(tokens: list[bytes], width: int) -> int:
    """The fingerprint as an unsigned number; 0 without words."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(tokens, width):
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(width: int) -> Callable:
    def make():
        def of_row(doc_id, text):
            return doc_id, int(np.uint64(simhash(words(text), width)).view(np.int64))

        return of_row

    return per_row(make, pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane b holds bit b of the fingerprints 64 * w to 64 * w + 63."""
    lanes = -(-len(prints) // BITS) * BITS
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.zeros((BITS, lanes), np.uint8)
    planes[:, : len(prints)] = bits.T
    return np.packbits(planes, axis=1, bitorder="little").view("<u8")


def within(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of the two arrays that differ in at most ``radius`` bits."""
    planes = bit_planes(right)
    width = planes.shape[1]
    unused = np.zeros(width * BITS, np.uint8)
    unused[len(right) :] = 1
    over = np.repeat(np.packbits(unused, bitorder="little").view("<u8")[None, :], len(left), axis=0)
    # distance of a lane = sum of 2**k * digits[k]; over is set for good once it is more than the radius
    digits = [np.zeros_like(over) for _ in range((radius + 1).bit_length())]
    alive, masks = np.arange(len(left)), (left[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)) * FULL
    for start in range(0, BITS, PLANES):
        for b in range(start, start + PLANES):
            carry = planes[b][None, :] ^ masks[:, b][:, None]
            for digit in digits:
                carry, digit[...] = digit & carry, digit ^ carry
            over |= carry  # never lost: a lane that wraps round has been marked
            beyond = FULL
            for k, digit in enumerate(digits):
                beyond = beyond & (digit if (radius + 1) >> k & 1 else ~digit)
            over |= beyond
        still = (over != FULL).any(axis=1)
        if not still.all():
            alive, masks, over = alive[still], masks[still], over[still]
            digits = [digit[still] for digit in digits]
        if not len(alive):
            return alive, alive
    hit = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")
    row, column = np.nonzero(hit)
    return alive[row], column


def spanning(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same of the nodes 0 to n - 1 as all links do, fewer than n."""
    label, kept = np.arange(n), [(u[:0], v[:0])]
    while len(u):
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        apart = low != high
        u, v, low, high = u[apart], v[apart], low[apart], high[apart]
        roots, first = np.unique(high, return_index=True)
        kept.append((u[first], v[first]))
        moved = np.arange(n)
        moved[roots] = low[first]  # always to a smaller label, so there are no circles
        while (moved != moved[moved]).any():
            moved = moved[moved]
        label = moved[label]
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _links_of(prints: np.ndarray, outer: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of the links inside a block, or between its two sides if it has an outer one."""
    left, right = (prints[outer], prints[~outer]) if outer.any() else (prints, prints)
    nodes = np.unique(prints)
    u = v = np.zeros(0, np.int64)
    for start in range(0, len(left), BLOCK):
        i, j = within(left[start : start + BLOCK], right, radius)
        u = np.concatenate([u, np.searchsorted(nodes, left[start + i])])
        v = np.concatenate([v, np.searchsorted(nodes, right[j])])
        u, v = spanning(len(nodes), u, v)
    return nodes[u].view(np.int64), nodes[v].view(np.int64)


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _compare_blocks(radius: int) -> Callable:
    """Reads rows (block, outer, fp) sorted by block. A block is held until it ends; small ones are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, held, packed = None, [], []

        def compared(parts):
            prints = np.concatenate([p for p, _ in parts])
            outer = np.concatenate([o for _, o in parts])
            if len(prints) > 1:
                u, v = _links_of(prints, outer, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=LINKS)

        def closed():
            """A finished block: one with an outer side is compared now, others wait until they fill a block."""
            nonlocal packed
            if any(o.any() for _, o in held):
                yield from compared(held)
                return
            if packed and sum(len(p) for p, _ in packed + held) > BLOCK:
                yield from compared(packed)
                packed = []
            packed += held

        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            outer = batch.column("outer").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if a == b:
                    continue
                if block[a] != open_block:
                    yield from closed()
                    open_block, held = block[a], []
                held.append((prints[a:b], outer[a:b]))
        yield from closed()
        if packed:
            yield from compared(packed)

    return run


def _keys(radius: int) -> list[Column]:
    """A key for each pair of the parts of a fingerprint, with the number of the pair in front."""
    parts = radius + 2
    cuts = [BITS * k // parts for k in range(parts + 1)]
    piece = [
        F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)).cast("bigint") for k in range(parts)
    ]
    return [
        F.struct(F.lit(n).alias("side"), piece[a].alias("a"), piece[b].alias("b"))
        for n, (a, b) in enumerate(combinations(range(parts), 2))
    ]


def links_within(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that differ in at most ``radius`` bits, as many as join all that belong together."""
    if not 0 <= radius <= 6:
        raise ValueError("radius: 0 to 6")
    entries = prints.select("fp", F.explode(F.array(*_keys(radius))).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    # Written, so that its size is known and a key with many entries is not tied to the task that counted them.
    sizes = stage(sizes.select("key", F.ceil(F.col("size") / BLOCK).cast("bigint").alias("n")), "sizes")
    placed = entries.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "n"))
    # Part i of a key meets itself in block (i, i) and every later part j in (i, j), there as the outer side.
    first = F.transform(
        F.sequence("own", F.col("n") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), (j != F.col("own")).alias("outer"))
    )
    second = F.transform(
        F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("own")), lambda i: i < F.col("own")),
        lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("outer")),
    )
    rows = placed.select("fp", "key", F.explode(F.concat(first, second)).alias("at"))
    # Keys that meet in one hash are compared together, which finds links all the same; the last bit keeps blocks of two sides apart.
    name = F.xxhash64("key", "at.i", "at.j").bitwiseAND(F.lit(-2)) + (F.col("at.i") != F.col("at.j")).cast("bigint")
    rows = rows.select("fp", name.alias("block"), F.col("at.outer").alias("outer"))
    return (
        rows.repartition("block").sortWithinPartitions("block").select("block", "fp", "outer")
        .mapInArrow(_compare_blocks(radius), "u bigint, v bigint")
    )


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Rows are linked when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest id that
    can be reached over links, the own included. The hash of a shingle is XXH64 with seed 42.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any other. A row without an id has its place in
    a component, but gives it no id: a component of such rows only has a null one. Repeated rows and ties need no care.
    An empty table gives an empty one. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    with small_batches(docs.sparkSession):
        printed = stage(rows.mapInArrow(_fingerprints(width), "doc_id bigint, fp bigint"), "simhashes")
    prints = stage(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = stage(components(links_within(prints.select("fp"), radius), "u", "v"), "roots")
    linked = roots.join(prints, roots["node"] == prints["fp"]).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "component_id")
    known = prints.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return printed.join(stage(known, "known"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
