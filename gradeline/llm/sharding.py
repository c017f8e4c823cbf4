"""Minimax contiguous sharding, in DataFrame expressions only.

Rows are ordered by a hash of their group, and atoms are the ranges of that order with the same 16
leading bits, so equal groups are never cut. The sizes of the atoms come from one aggregation with
partial sums; there are 65,536 of them at most, whatever the input, so they fit one array. A binary
search over the capacity, each step a greedy pass over that array, finds the smallest capacity with
which the atoms fit the shards. One further pass cuts: a shard ends where it comes nearest to an even
share of what is left, if the rest still fits the shards left, and never passes the capacity. So one
large group, which sets the capacity, does not fill other shards as high and leave the rest empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ATOM_BITS = 16
ROWS_IN_ORDER = 1_000


def _greedy(capacity: str) -> str:
    """SQL for the number of shards that the atoms ``atoms`` fill at a capacity."""
    return (
        "aggregate(atoms, named_struct('shards', 1, 'load', 0L), (g, x) -> if(g.load + x.bytes <= " + capacity + ","
        " named_struct('shards', g.shards, 'load', g.load + x.bytes),"
        " named_struct('shards', g.shards + 1, 'load', x.bytes)), g -> g.shards)"
    )


def smallest_capacity(n_shards: int) -> str:
    """SQL for the smallest capacity at which the array ``atoms`` fits n shards.

    No capacity under the mean or under the largest atom will do, and the sum of both always does.
    """
    least = "greatest(cast(ceil(total / {n}) AS bigint), largest)".format(n=n_shards)
    middle = "((b.lo + b.hi) div 2)"
    step = (
        f"if(b.lo >= b.hi, b, if({_greedy(middle)} <= {n_shards}, named_struct('lo', b.lo, 'hi', {middle}),"
        f" named_struct('lo', {middle} + 1, 'hi', b.hi)))"
    )
    return f"aggregate(sequence(1, 63), named_struct('lo', {least}, 'hi', {least} + largest), (b, i) -> {step}, b -> b.lo)"


def _cuts(n_shards: int) -> str:
    """SQL for the first atom of every shard but the first.

    ``starts`` holds the first atom of every shard, the last shard first, when shards are filled from the end: what
    begins at ``starts[k]`` or later fits k + 1 shards. ``large`` holds the bytes from each atom above the mean to the end,
    and that atom's. Such an atom counts as a shard of its own; what lies before the next one is shared out evenly over
    the nearest whole number of shards.
    """
    starts = (
        "aggregate(reverse(atoms), named_struct('load', 0L, 'first', -1, 'starts', cast(array() AS array<int>)), (g, x) ->"
        " if(g.load + x.bytes <= capacity, named_struct('load', g.load + x.bytes, 'first', x.atom, 'starts', g.starts),"
        " named_struct('load', x.bytes, 'first', x.atom, 'starts', concat(g.starts, array(g.first)))), g -> g.starts)"
    )
    large = (
        "aggregate(atoms, named_struct('rest', total, 'large', cast(array() AS array<struct<rest:bigint,bytes:bigint>>)), (g, x) ->"
        f" named_struct('rest', g.rest - x.bytes, 'large', if(x.bytes > total / {n_shards},"
        " concat(g.large, array(named_struct('rest', g.rest, 'bytes', x.bytes))), g.large)), g -> g.large)"
    )

    def target(shards: str) -> str:
        """Of a shard that begins where ``g.rest`` bytes and so many shards are left."""
        ahead = "filter(g.large, l -> l.rest <= g.rest)"
        gap = f"(g.rest - coalesce(array_max(transform({ahead}, l -> l.rest)), 0L))"
        even = f"((g.rest - aggregate({ahead}, 0L, (s, l) -> s + l.bytes)) / greatest({shards} - size({ahead}), 1))"
        return f"if({gap} = 0, 0.0D, {gap} / greatest(round({gap} / {even}), 1.0D))"

    def state(shards: str, load: str, target: str, rest: str, seen: str, cuts: str) -> str:
        return (
            f"named_struct('shards', {shards}, 'load', {load}, 'target', {target}, 'rest', {rest}, 'seen', {seen}, 'cuts', {cuts},"
            " 'starts', g.starts, 'large', g.large, 'n', g.n)"
        )

    # shards: those after the one being filled; rest: bytes from this atom on; seen: atoms before it.
    begin = f"named_struct('rest', total, 'starts', {starts}, 'large', {large}, 'n', size(atoms))"
    first = state(str(n_shards - 1), "0L", target(str(n_shards)), "g.rest", "0", "cast(array() AS array<int>)")
    added = state("g.shards", "g.load + x.bytes", "g.target", "g.rest - x.bytes", "g.seen + 1", "g.cuts")
    closed = state("g.shards - 1", "x.bytes", target("g.shards"), "g.rest - x.bytes", "g.seen + 1", "concat(g.cuts, array(x.atom))")
    ends = (
        "g.seen > 0 AND g.shards > 0 AND (g.load + x.bytes > capacity OR g.n - g.seen <= g.shards"
        " OR (2 * g.load + x.bytes > 2 * g.target AND x.atom >= coalesce(get(g.starts, g.shards - 1), -1)))"
    )
    # The array of one entry holds what is the same for all atoms, so that it is computed once.
    return (
        f"transform(array({begin}), g -> aggregate(atoms, {first}, (g, x) -> if({ends}, {closed}, {added}), g -> g.cuts))[0]"
    )


def assign_shards(rows: DataFrame, n_shards: int, group: Column, size: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    ``group`` tells which rows must stay together and ``size`` (not negative) what they weigh; slots follow the
    hash of the group and then ``order``. Give the narrow columns that are needed: the rows are
    written once, so that their texts are read once. No shard has more than the smallest capacity, and none
    is empty unless there are fewer atoms than shards. An empty table gives an empty one. Names that begin with
    ``__shard`` are taken.
    """
    hashed = F.xxhash64(group)
    atom = F.shiftrightunsigned(hashed, 64 - ATOM_BITS).cast("int")
    rows = stage(rows.withColumns({"__shard_atom": atom, "__shard_hash": hashed, "__shard_size": size.cast("bigint")}), "sharded")
    atoms = rows.groupBy(F.col("__shard_atom").alias("atom")).agg(
        F.sum("__shard_size").alias("bytes"), F.count("*").alias("rows")
    )
    index = atoms.agg(
        F.array_sort(F.collect_list(F.struct("atom", "bytes", "rows"))).alias("atoms"),
        F.sum("bytes").alias("total"), F.max("bytes").alias("largest"),
    )
    # One row, written: else the search would be moved into the pass that cuts, and run once per atom.
    index = stage(index.withColumn("capacity", F.expr(smallest_capacity(n_shards))), "capacity").withColumn("cuts", F.expr(_cuts(n_shards)))
    placed = index.select("cuts", F.inline("atoms")).select(
        "atom", "rows", F.expr("size(filter(cuts, c -> c <= atom))").alias("shard"),
        F.ceil(F.col("rows") / ROWS_IN_ORDER).alias("parts"),
    )
    earlier = Window.partitionBy("shard").orderBy("atom").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    # At most 65,536 rows of five numbers.
    found = rows.join(F.broadcast(placed), F.col("__shard_atom") == F.col("atom")).withColumn(
        "__shard_part", F.pmod(F.xxhash64(*order, F.lit("part")), "parts")
    )
    before = Window.partitionBy("atom").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.filter("parts > 1").groupBy("atom", F.col("__shard_part").alias("part")).agg(F.count("*").alias("n"))
    parts = parts.select("atom", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    numbered = found.withColumn("__shard_number", F.row_number().over(
        Window.partitionBy("__shard_atom", "__shard_part").orderBy("__shard_hash", *order)
    ))
    joined = numbered.join(
        parts.select(F.col("atom").alias("__shard_atom"), F.col("part").alias("__shard_part"), "skip"),
        ["__shard_atom", "__shard_part"], "left",
    )
    kept = [c for c in rows.columns if not c.startswith("__shard")]
    slot = F.col("first") + F.coalesce("skip", F.lit(0)) + F.col("__shard_number") - 1
    return joined.select(*kept, F.col("shard").cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law of near-equal bytes.

    A text weighs its UTF-8 bytes plus 8. Equal texts share a shard; null and empty texts are equal. Null and
    repeated ids are rows like others. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(8).cast("bigint")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
    )
    placed = assign_shards(rows, n_shards, F.col("group"), F.col("size"), ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
