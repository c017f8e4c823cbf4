"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two values, its minimum and its maximum, so that a
signature of 128 values costs 64 hash evaluations a shingle. Four values of different
permutations make a band. At a similarity of 0.8 a pair shares none of 32 bands with a
probability of 5e-8. What shares a band is confirmed on the full sets:

1. Documents with equal sets are one class; only classes go on.
2. In each band bucket the most central class (the one with the most band mates over all bands)
   is the hub, and every other member is compared with it. That is one comparison per entry,
   however large the bucket.
3. Buckets whose other members are not in one component by then are compared in full: by hub, in
   blocks of bounded size, the members outside the hub's largest component against all members.
   A block task returns pairs of components that a link joins, never the pairs of documents.

So no link between two candidates is lost, no pair list grows with the square of a group, and no
group is held in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, in_slots, mixed, per_row, scratch, shingles, slots_of, small_batches, stage, words
from .components import components

PERMUTATIONS = 64
BAND_ROWS = 4
BLOCK_SETS = 256
BLOCK_HASHES = 200_000
AT_ONCE = 4096


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n bijections x -> a * x + b of the 64-bit numbers."""
    numbers = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return numbers[:n, None] | np.uint64(1), numbers[n:, None]


def min_max(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each permutation, then the maximum of each; long sets are taken in parts."""
    low = high = None
    for start in range(0, len(values), AT_ONCE):
        moved = values[None, start : start + AT_ONCE] * a + b
        least, most = moved.min(axis=1), moved.max(axis=1)
        low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band; the number of the band is part of it."""
    bands = signature[: len(signature) // rows * rows].reshape(-1, rows)
    keys = np.arange(len(bands), dtype=np.uint64)
    for k in range(rows):
        keys = mixed(keys) + bands[:, k]
    return mixed(keys).view(np.int64)


SIGNATURE = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())),
])
SET = pa.schema([("node", pa.binary()), ("hashes", pa.list_(pa.int64()))])


def _set_of(hashes: WordHashes, text: str | None, width: int) -> tuple[np.ndarray, bytes | None]:
    values = np.unique(shingles(hashes.of(words(text)), width))
    return values, xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def _signer(width: int, n_permutations: int, band_rows: int) -> Callable:
    def make():
        hashes, (a, b) = WordHashes(), permutations(n_permutations)

        def of_row(doc_id, text_key, text):
            values, node = _set_of(hashes, text, width)
            bands = band_keys(min_max(values, a, b), band_rows).tolist() if node else []
            return doc_id, text_key, len(values), node, bands

        return of_row

    return per_row(make, SIGNATURE)


def _sets(width: int) -> Callable:
    def make():
        hashes = WordHashes()

        def of_row(text):
            values, node = _set_of(hashes, text, width)
            return node, values.view(np.int64)

        return of_row

    return per_row(make, SET, rows=200)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of bounded 0/1 tables."""
    every = np.concatenate(left + right)
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    column = np.where(count[column] > 1, dense[column], -1)
    sizes = [len(x) for x in left + right]
    row = np.repeat(np.arange(len(sizes)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    found = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for start in range(0, int((count > 1).sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sizes), width), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        found += part[: len(left)] @ part[len(left) :].T
    return found.astype(np.int64)


def _joined_components(percent: int) -> Callable:
    """For one pair of blocks: the pairs of components between which a link was found."""

    def run(block: pa.Table) -> pa.Table:
        outer = np.array(block["outer"].to_pylist(), bool)
        component = np.array(block["component"].to_pylist(), object)
        hashes = block["hashes"].combine_chunks()
        values, offsets = hashes.values.to_numpy(zero_copy_only=False), hashes.offsets.to_numpy()
        sets = [values[offsets[i] : offsets[i + 1]] for i in range(len(hashes))]
        left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
        pairs: set[tuple[bytes, bytes]] = set()
        if len(left) and len(right):
            shared = _shared([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(s) for s in sets])
            union = size[left][:, None] + size[right][None, :] - shared
            linked = (100 * shared >= percent * union) & (component[left][:, None] != component[right][None, :])
            pairs = {(component[left[i]], component[right[j]]) for i, j in np.argwhere(linked)}
        a, b = ([p[k] for p in pairs] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _similar(percent: int):
    shared = F.size(F.array_intersect("hashes", "hub_hashes"))
    return 100 * shared >= percent * (F.size("hashes") + F.size("hub_hashes") - shared)


def _rest(members: DataFrame, hubs: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of components that are linked by two members of a bucket of which neither is the hub."""
    spokes = (
        members.filter("size > 2").join(hubs, "key").filter("node != hub").join(roots, "node", "left")
        .select("key", "hub", "node", "n_shingles", F.coalesce("root", "node").alias("component"))
    )
    split = spokes.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    near = stage(spokes.join(split.select("key"), "key", "left_semi").drop("key").distinct(), "near")
    parts = near.groupBy("hub", "component").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("hashes"))
    whole = parts.groupBy("hub").agg(
        F.max_by("component", F.struct("rows", "component")).alias("main"),
        F.sum("rows").alias("rows"), F.sum("hashes").alias("hashes"),
        F.max("rows").alias("main_rows"), F.max_by("hashes", F.struct("rows", "component")).alias("main_hashes"),
    )

    def blocks(rows, hashes):
        return F.greatest(F.ceil(rows / BLOCK_SETS), F.ceil(hashes / BLOCK_HASHES), F.lit(1))

    cut = whole.select(
        "hub", "main", blocks(F.col("rows"), F.col("hashes")).alias("n_all"),
        blocks(F.col("rows") - F.col("main_rows"), F.col("hashes") - F.col("main_hashes")).alias("n_outer"),
    )
    # Written, so that its size is known and a hub with many members is not tied to the task that counted them.
    placed = near.join(stage(cut, "cut"), "hub")
    own = F.xxhash64("node")
    everything = placed.select(
        "hub", "node", "component", F.lit(False).alias("outer"), F.pmod(own, "n_all").alias("all_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_outer") - 1)).alias("outer_block"),
    )
    outside = placed.filter("component != main").select(
        "hub", "node", "component", F.lit(True).alias("outer"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_all") - 1)).alias("all_block"),
        F.pmod(own, "n_outer").alias("outer_block"),
    )
    return (
        everything.union(outside).join(sets, "node").drop("node")
        .groupBy("hub", "all_block", "outer_block")
        .applyInArrow(_joined_components(percent), "a binary, b binary")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    n_permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Rows are linked when 100 * shared >= percent * union of their sets of ``width``-word shingles;
    a text with fewer words is one shingle. ``component_id`` is the smallest id that can be
    reached over links, the own included, and ``kept`` marks the row with that id.

    Null and empty texts have no shingles and are linked with nothing. A row without an id is
    linked with nothing, has a null component and is kept. Rows that repeat an id are rows of
    their own; copies among them are kept or dropped together. Other columns are not read.
    Equal sets, ties and an empty table need no special care.
    """
    found = _with_components(docs, id_col, text_col, width, percent, n_permutations, band_rows)
    return found.drop("text_key")


def _with_components(
    docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, n_permutations: int, band_rows: int
) -> DataFrame:
    """As :func:`near_duplicates`, with a hash of the text that tells rows with the same id apart."""
    with scratch():
        return _found(docs, id_col, text_col, width, percent, n_permutations, band_rows)


def _found(
    docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, n_permutations: int, band_rows: int
) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    with small_batches(docs.sparkSession):
        signed = stage(rows.mapInArrow(
            _signer(width, n_permutations, band_rows),
            "doc_id bigint, text_key bigint, n_shingles bigint, node binary, bands array<bigint>",
        ), "signatures")
    linkable = signed.filter("doc_id IS NOT NULL AND node IS NOT NULL")
    classes = stage(linkable.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
    ), "classes")

    entries = classes.select("node", "first_id", "n_shingles", F.explode("bands").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stage(entries.join(sizes, "key"), "members")
    mates = members.groupBy("node").agg(F.sum("size").alias("mates"))
    hubs = members.join(mates, "node").groupBy("key").agg(F.max_by("node", F.struct("mates", "node")).alias("hub"))
    hubs = stage(hubs.join(classes.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n")), "hub"), "hubs")

    candidates = members.select(F.col("first_id").alias("doc_id")).distinct()
    # First by slots of the hashed id, so that the texts of other documents stay where they are.
    hashed = F.xxhash64("doc_id")
    asked = in_slots(rows.withColumn("hashed", hashed), "hashed", slots_of(candidates, hashed)).filter("__hit")
    wanted = asked.join(candidates, "doc_id", "left_semi").select("text")
    with small_batches(docs.sparkSession):
        sets = stage(
            wanted.mapInArrow(_sets(width), "node binary, hashes array<bigint>").filter("node IS NOT NULL").dropDuplicates(["node"]), "sets"
        )
    pairs = (
        members.join(hubs, "key").filter("node != hub")
        .filter(100 * F.least("n_shingles", "hub_n") >= percent * F.greatest("n_shingles", "hub_n"))
        .select("hub", "node").distinct()
    )
    hub_sets = sets.select(F.col("node").alias("hub"), F.col("hashes").alias("hub_hashes"))
    links = pairs.join(sets, "node").join(hub_sets, "hub").filter(_similar(percent)).select("hub", "node")
    roots = stage(components(links, "hub", "node"), "roots")
    further = components(_rest(members, hubs.select("key", "hub"), roots, sets, percent), "a", "b")
    further = stage(further.select(F.col("node").alias("root"), F.col("root").alias("final")), "further")
    nodes = classes.select("node", "first_id").join(roots, "node", "left").select(
        "node", "first_id", F.coalesce("root", "node").alias("root")
    ).join(further, "root", "left").select("node", "first_id", F.coalesce("final", "root").alias("root"))
    nodes = stage(nodes, "nodes")
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component"))
    component = nodes.join(least, "root").select("node", "component")
    found = signed.select("doc_id", "text_key", "n_shingles", "node").join(component, "node", "left").select(
        "doc_id", "text_key", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
    return stage(found, "components", lasting=True)  # narrow; all other tables of the search can go


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    n_permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS,
) -> DataFrame:
    """``docs`` without the documents that are not the first of their component. See :func:`near_duplicates`.

    Rows with the same id and text stay or go together, those with the same id and another text are judged on their own;
    rows without an id stay. All columns stay as they are. Only the texts of rows that are dropped, and of few others, leave their place.
    """
    found = _with_components(docs, id_col, text_col, width, percent, n_permutations, band_rows)
    hashed = F.xxhash64("doc_id", "text_key")
    dropped = found.filter("NOT kept").select("doc_id", "text_key").distinct().withColumn("hashed", hashed)
    dropped = stage(dropped, "dropped")
    # The documents travel as one column, so that their names cannot clash.
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key")
    ).withColumn("hashed", hashed)
    rows = in_slots(rows, "hashed", slots_of(dropped, F.col("hashed")))
    unsure = rows.filter("__hit").join(dropped, ["hashed", "doc_id", "text_key"], "left_anti")
    return rows.filter("NOT __hit").select("row.*").unionAll(unsure.select("row.*"))
