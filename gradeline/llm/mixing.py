"""Temperature mixing of sources, in DataFrame expressions only.

A source with a share p of all tokens gets the weight p**a / sum(p**a). The exponent a between 0
(all sources alike) and 1 (as they are) is bisected until the mixture meets a target entropy, or
until no source is repeated more often than allowed. The weights are then realised as a stream
of blocks of a fixed number of tokens: each source is walked in a new pseudo-random order in every
epoch until its share of the budget is used up, and its walk is spread evenly over the blocks, so that
every block has the target weights as nearly as whole documents allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stage

BLOCK_TOKENS = 1 << 18
STEPS = 48
WALK_PARTS = 1 << 16
PART_TOKENS = 1 << 18
#: Blocks of written-out documents; a larger mixture has larger blocks.
MOST_BLOCKS = 1 << 16
#: Rows of about 50 bytes that are handed to every task at most.
HANDED_OUT = 1 << 20


def text_tokens(text: Column) -> Column:
    """An estimate of byte-level tokens that needs no tokenizer: a quarter of the UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("bigint"))


def _exponent(target_entropy: float | None, max_repetition: float | None, budget: int | None) -> str:
    """SQL for the exponent; ``sizes`` holds (tokens of a source, number of such sources)."""
    middle = "((b.lo + b.hi) / 2)"
    mass = f"aggregate(sizes, 0.0D, (s, x) -> s + x.n * pow(x.t / largest, {middle}))"
    if target_entropy is not None:
        p = f"(pow(x.t / largest, {middle}) / w)"
        entropy = f"aggregate(sizes, 0.0D, (s, x) -> s - x.n * {p} * ln({p}))".replace("w)", f"{mass})")
        met, wants_low = f"{entropy} >= {float(target_entropy)}D", False
    else:
        if budget is None:
            repeats = f"pow(largest / smallest, 1 - {middle})"
        else:
            repeats = f"pow(smallest / largest, {middle}) / {mass} * {int(budget)} / smallest"
        met, wants_low = f"{repeats} <= {float(max_repetition)}D", True
    lower, upper = f"named_struct('lo', b.lo, 'hi', {middle})", f"named_struct('lo', {middle}, 'hi', b.hi)"
    step = f"if({met}, {lower if wants_low else upper}, {upper if wants_low else lower})"
    end = "hi" if wants_low else "lo"
    return f"round(aggregate(sequence(1, {STEPS}), named_struct('lo', 0.0D, 'hi', 1.0D), (b, i) -> {step}, b -> b.{end}), 9)"


def _hash(*parts: Column) -> Column:
    """60 bits of an MD5, as a number that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def _source_key(source_col: str) -> Column:
    source = F.col(source_col).cast("string")
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def _tokens(tokens: Column | None, text_col: str) -> Column:
    """At least one token a document."""
    one = F.lit(1).cast("bigint")
    return text_tokens(F.col(text_col).cast("string")) if tokens is None else F.greatest(F.coalesce(tokens.cast("bigint"), one), one)


def _name(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint").cast("string"), F.lit(""))


def _block() -> Column:
    return F.expr("cast((cast(at AS decimal(19,0)) * blocks) div quota AS bigint)")


def _turn(seed: int, epoch: Column, name: Column) -> Column:
    """What the copies of a block are ordered by."""
    return _hash(F.lit(str(seed)), F.lit("block"), epoch.cast("string"), name)


def _part(walk: str, parts: str) -> Column:
    return F.expr(f"shiftright(shiftright({walk}, 29) * {parts}, 31)")


def _walked(
    docs: DataFrame, source_col: str, id_col: str, tokens: Column | None, text_col: str, target_entropy: float | None,
    max_repetition: float | None, budget: int | None, block_tokens: int, seed: int, most_blocks: int | None = None,
) -> DataFrame:
    """A row per copy, with its place in the walk of its source."""
    size = _tokens(tokens, text_col)
    rows = stage(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        _source_key(source_col).alias("key"), size.cast("bigint").alias("tokens"),
    ), "mixed")
    totals = rows.groupBy("key").agg(F.sum("tokens").alias("total"))
    alike = totals.groupBy(F.col("total").cast("double").alias("t")).agg(F.count("*").alias("n"))
    whole = alike.agg(
        F.array_sort(F.collect_list(F.struct("t", "n"))).alias("sizes"), F.max("t").alias("largest"), F.min("t").alias("smallest"),
    ).withColumn("exponent", F.expr(_exponent(target_entropy, max_repetition, budget)))
    whole = whole.withColumn("mass", F.expr("aggregate(sizes, 0.0D, (s, x) -> s + x.n * pow(x.t / largest, exponent))"))
    spent = F.expr("round(largest * mass)" if budget is None else f"{int(budget)}D").cast("bigint")
    whole = whole.select("largest", "exponent", "mass", spent.alias("spent"), F.lit(1).alias("one"))
    blocks = f"greatest(1L, cast(ceil(spent / {block_tokens}) AS bigint))"
    plan = totals.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").withColumn(  # one row
        "weight", F.expr("round(pow(total / largest, exponent) / mass, 12)")
    ).select(
        "key", "total", "weight", "exponent", F.expr("cast(round(weight * spent) AS bigint)").alias("quota"),
        F.expr(f"least({most_blocks}L, {blocks})" if most_blocks else blocks).alias("blocks"),
        F.expr(f"least({WALK_PARTS}L, cast(ceil(total / {PART_TOKENS}) AS bigint))").alias("parts"),
    )
    plan = stage(plan.withColumn("epochs", F.expr("cast(ceil(quota / total) AS bigint)")), "plan")
    copies = rows.join(plan, "key").select("*", F.explode(F.expr("sequence(0L, greatest(epochs, 1L) - 1)")).alias("epoch"))
    walk = _hash(F.lit(str(seed)), F.col("epoch").cast("string"), _name(F.col("doc_id")))
    # A source is walked in parts of equal ranges of the hash, so that no task holds all of a large source.
    copies = copies.withColumn("walk", walk).withColumn("part", _part("walk", "parts"))
    part_sums = copies.groupBy("key", "epoch", "part").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("key", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_starts = part_sums.select("key", "epoch", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("key", "epoch", "part").orderBy("walk", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    return copies.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(
        part_starts, ["key", "epoch", "part"]
    ).withColumn("at", F.expr("epoch * total + skip + within")).filter("at < quota")


def mix(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", tokens: Column | None = None, text_col: str = "text",
    target_entropy: float | None = None, max_repetition: float | None = 2.0, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 0,
) -> DataFrame:
    """One row per copy of a document in the mixture.

    Columns: doc_id, source, tokens, epoch, block, slot (gapless from 0 in each block), weight (of the
    source) and exponent. ``max_repetition`` holds unless ``target_entropy`` (in nats) is given. Without a budget,
    the budget is what lets the largest source pass once, so that no document is left out. With one, a source
    may end within an epoch; a document that begins before its source's quota ends is still taken.

    A null source is a source of its own. Null ids and null texts are rows like others; repeated rows are
    placed one by one. Every document has at least one token. An empty table gives an empty one. Other columns
    are not read.
    """
    walked = _walked(docs, source_col, id_col, tokens, text_col, target_entropy, max_repetition, budget, block_tokens, seed)
    walked = walked.withColumn("block", _block())
    turn = _turn(seed, F.col("epoch"), _name(F.col("doc_id")))
    in_block = Window.partitionBy("block").orderBy("turn", "doc_id", "epoch", "key", "tokens")
    return walked.withColumn("turn", turn).withColumn("slot", F.row_number().over(in_block).cast("bigint") - 1).select(
        "doc_id", "source", "tokens", "epoch", "block", "slot", "weight", "exponent"
    )


def mixed_documents(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", tokens: Column | None = None, text_col: str = "text",
    target_entropy: float | None = None, max_repetition: float | None = 2.0, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 0,
) -> DataFrame:
    """The documents themselves, each as often as :func:`mix` places it and in its order; the columns of ``docs`` only.

    The partitions are ranges of blocks, and the rows of each lie in the order of block and slot. The copies
    taken of a source are a prefix of its walk, so the last copy of each source decides for every row on its own, and
    the first copies of its blocks, listed by part of the walk, tell the block: texts are not joined by id and move
    once, to their place. The lists are handed to every task if they have at most ``HANDED_OUT`` entries, else the planner joins them.
    Rows that equal the last copy in id and tokens all count as it does, and rows that equal each other in both lie in one block.
    There are at most ``MOST_BLOCKS`` blocks.
    """
    least = F.lit(-(2**63)).cast("bigint")
    with scratch():
        walked = _walked(
            docs, source_col, id_col, tokens, text_col, target_entropy, max_repetition, budget, block_tokens, seed, MOST_BLOCKS
        )
        place = F.struct("epoch", "walk", F.coalesce("doc_id", least).alias("id"), "tokens")
        begun = stage(walked.withColumn("block", _block()).groupBy("key", "epoch", "part", "block").agg(
            F.min(place).alias("first"), F.max(place).alias("last"), F.max("parts").alias("parts"), F.max("blocks").alias("blocks"),
        ), "blocks")
        ends = stage(begun.groupBy("key").agg(
            F.max("last").alias("end"), F.max("parts").alias("parts"), F.max("blocks").alias("blocks"),
        ), "ends", lasting=True)
        listed = stage(begun.groupBy("key", "epoch", "part").agg(
            F.array_sort(F.collect_list(F.struct("first", "block"))).alias("listed")
        ), "listed", lasting=True)
        entries = begun.count()
    if entries <= HANDED_OUT:  # ends and lists have no more entries than that
        ends, listed = F.broadcast(ends), F.broadcast(listed)
    # The documents travel as one column, so that their names cannot clash.
    joined = docs.select(
        F.struct("*").alias("row"), _source_key(source_col).alias("key"), _tokens(tokens, text_col).cast("bigint").alias("tokens"),
        F.coalesce(F.col(id_col).cast("bigint"), least).alias("id"), _name(F.col(id_col)).alias("name"),
    ).join(ends, "key")

    def at(epoch: Column) -> Column:
        walk = _hash(F.lit(str(seed)), epoch.cast("string"), F.col("name"))
        return F.struct(epoch.alias("epoch"), walk.alias("walk"), F.col("id"), F.col("tokens"))

    places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("end.epoch")), at)
    copies = joined.withColumn("at", F.explode(F.filter(places, lambda here: here <= F.col("end"))))
    copies = copies.withColumns({
        "epoch": F.col("at.epoch"), "part": _part("at.walk", "parts"), "turn": _turn(seed, F.col("at.epoch"), F.col("name")),
    }).join(listed, ["key", "epoch", "part"])
    block = F.expr("array_max(transform(filter(listed, b -> b.first <= at), b -> b.block))")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Blocks are alike in tokens, so equal ranges of them are even without a look at the rows.
    ordered = copies.withColumn("block", block).select("row", "key", "epoch", "id", "tokens", "turn", "block", "blocks").repartitionById(
        n, F.expr(f"cast(least(block * {n} div blocks, {n - 1}) AS int)")
    ).sortWithinPartitions("block", "turn", "id", "epoch", "key", "tokens")
    return ordered.select("row.*")
