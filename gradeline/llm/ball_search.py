"""Ranked lexical search: exact inner products over sparse ball trees.

A document is a sparse vector of term values, an item a vector of term counts, and the score is their inner product. Items are
taken in blocks of a bounded number of items and terms, and each block is held against all documents:

1. One pass reads the whole texts and writes, for each document, its length and the terms it has in common with the block.
2. From that small table come the number of documents, their length and the document frequencies of the block's terms.
3. Each task builds ball trees over bounded runs of its documents. A node knows the centroid of its documents, the radius of the ball around it,
   and the radius along each term. No document of the node can score more than ``q·c + min(|q| R, q·r)``, rounded up. Each item walks the tree
   best-first and leaves what cannot reach its tenth best score so far; documents of a leaf are scored in 64-bit integers.
4. The best of each task are ranked per item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_row, small_batches, stage

#: A block of items ends with the item that reaches one of these.
BLOCK_ITEMS = 256
BLOCK_TERMS = 4096
LEAF = 16
TREE_DOCS = 2048
#: Numbers in the centroids of a tree.
TREE_CELLS = 1 << 20
#: Rounding errors of sums of doubles stay below this share.
SLACK = 1e-9

_SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased."""
    return text.encode().lower().translate(_SPACED).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Block:
    """Items with their term counts; terms are numbered."""

    ids: list
    counts: list[dict[int, int]]
    terms: dict[bytes, int]


def item_blocks(items: Iterator) -> Iterator[Block]:
    ids, counts, known = [], [], {}
    for item_id, text in items:
        ids.append(item_id)
        counts.append({known.setdefault(t, len(known)): n for t, n in Counter(terms(text)).items()})
        if len(ids) >= BLOCK_ITEMS or len(known) >= BLOCK_TERMS:
            yield Block(ids, counts, known)
            ids, counts, known = [], [], {}
    if ids:
        yield Block(ids, counts, known)


VECTOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])


def _vectors(known: dict[bytes, int]) -> Callable:
    def make():
        get = known.get

        def of_row(doc_id, text):
            found = terms(text)
            tfs = Counter(k for k in map(get, found) if k is not None)
            return doc_id, len(found), list(tfs), list(tfs.values())

        return of_row

    return per_row(make, VECTOR)


class BallTree:
    """A tree over sparse vectors of whole numbers; nodes 2k + 1 and 2k + 2 lie below node k."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_terms: int, leaf: int = LEAF) -> None:
        """Entries of the vectors by row, and at least one row. All nodes of a level are made at once."""
        depth = max(0, math.ceil(math.log2(n_rows / leaf)))
        self.n_inner = 2**depth - 1
        squares = np.bincount(rows, values.astype(np.float64) ** 2, n_rows)
        order, cuts = np.arange(n_rows), np.array([0, n_rows])
        centroids, radii, ranges = [], [], []
        for level in range(depth + 1):
            nodes, node = len(cuts) - 1, np.empty(n_rows, np.int64)
            node[order] = np.repeat(np.arange(nodes), np.diff(cuts))
            at = node[rows]

            def times(points, at=at):
                """Each row times the point of its node."""
                return np.bincount(rows, values * points[at, columns], n_rows)

            def distances(points, node=node, times=times):
                return squares + np.einsum("ij,ij->i", points, points)[node] - 2 * times(points)

            def farthest(away, node=node, at=at, nodes=nodes, cuts=cuts):
                chosen = np.zeros(n_rows, bool)
                chosen[np.lexsort((away, node))[cuts[1:] - 1]] = True
                points, own = np.zeros((nodes, n_terms)), chosen[rows]
                points[at[own], columns[own]] = values[own]
                return points

            centroid = np.bincount(at * n_terms + columns, values, nodes * n_terms).reshape(nodes, n_terms) / np.diff(cuts)[:, None]
            away, widest, longest = distances(centroid), np.zeros(nodes), np.zeros(nodes)
            np.maximum.at(widest, node, away)
            np.maximum.at(longest, node, squares)
            centroids.append(centroid)
            radii.append(np.sqrt(widest + SLACK * longest))
            ranges += zip(cuts[:-1].tolist(), cuts[1:].tolist())
            if level < depth:
                # Halves along the line between two points far apart are the children.
                one = farthest(away)
                other = farthest(distances(one))
                order = np.lexsort((times(other - one), node))
                cuts = np.append(np.column_stack([cuts[:-1], (cuts[:-1] + cuts[1:]) // 2]), n_rows)
        high = [np.zeros((nodes, n_terms))]
        np.maximum.at(high[0], (at, columns), values)
        while len(high) <= depth:
            high.append(high[-1].reshape(-1, 2, n_terms).max(axis=1))
        self.order, self.ranges = order, ranges
        self.centroid, self.radius, self.high = np.concatenate(centroids), np.concatenate(radii), np.concatenate(high[::-1])
        place = np.empty(n_rows, np.int64)
        place[order] = np.arange(n_rows)
        sort = np.argsort(place[rows], kind="stable")
        self.columns, self.values = columns[sort], values[sort]
        self.starts = np.searchsorted(place[rows][sort], np.arange(n_rows + 1))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(nodes, queries): no document of the node scores more. The radius along a term is its greatest value less the centroid's."""
        ball = self.centroid @ queries.T + self.radius[:, None] * np.sqrt(np.einsum("ij,ij->i", queries, queries))
        return np.minimum(ball, self.high @ queries.T) * (1 + SLACK) + 1

    def scores(self, node: int, query: np.ndarray) -> np.ndarray:
        """Exact scores of the documents of a leaf."""
        a, b = self.ranges[node]
        first, last = self.starts[a], self.starts[b]
        sums = np.zeros(last - first + 1, np.int64)
        np.cumsum(query[self.columns[first:last]] * self.values[first:last], out=sums[1:])
        return sums[self.starts[a + 1 : b + 1] - first] - sums[self.starts[a:b] - first]


class Best:
    """The best documents of an item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def least(self) -> int:
        """What a document has to reach."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, -(2**63) if doc_id is None else -doc_id, doc_id is not None)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def documents(self) -> list[tuple[int, int | None]]:
        return [(score, -minus if known else None) for score, minus, known in self.heap]


def search(tree: BallTree, ids: list, queries: np.ndarray, best: list[Best]) -> int:
    """Adds the documents of the tree to the best of each query. Returns the number of documents scored."""
    bounds, scored = tree.bounds(queries.astype(np.float64)), 0
    for n, (query, mine) in enumerate(zip(queries, best)):
        upper = bounds[:, n].tolist()
        ahead = [(-upper[0], 0)]
        while ahead and -ahead[0][0] >= mine.least():
            _, node = heapq.heappop(ahead)
            if node < tree.n_inner:
                for child in (2 * node + 1, 2 * node + 2):
                    if upper[child] >= mine.least():
                        heapq.heappush(ahead, (-upper[child], child))
                continue
            found = tree.scores(node, query)
            scored += len(found)
            first = tree.ranges[node][0]
            for k in np.flatnonzero(found >= mine.least()).tolist():
                mine.add(int(found[k]), ids[tree.order[first + k]])
    return scored


BEST = pa.schema([("slot", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search_task(counts: list[dict[int, int]], weights: np.ndarray, n_docs: int, length: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = np.zeros((len(counts), len(weights)), np.int64)
        for row, own in enumerate(counts):
            queries[row, list(own)] = list(own.values())
        best = [Best(k) for _ in counts]
        at_once = max(LEAF, min(TREE_DOCS, TREE_CELLS // len(weights) * LEAF // 2))
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)  # at least one row
                lengths = pa.compute.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(part.num_rows), lengths)
                columns = part.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tfs = part.column("tfs").flatten().to_numpy(zero_copy_only=False)
                m = 25 + 75 * part.column("n").to_numpy(zero_copy_only=False) * n_docs // length
                values = weights[columns] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[rows]))
                tree = BallTree(rows, columns, values, part.num_rows, len(weights))
                search(tree, part.column("doc_id").to_pylist(), queries, best)
        found = [(slot, doc_id, score) for slot, mine in enumerate(best) for score, doc_id in mine.documents()]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], x.type) for c, x in enumerate(BEST)], schema=BEST)

    return run


def _ranked(rows: DataFrame, block: Block, id_type: str, k: int) -> DataFrame:
    spark = rows.sparkSession
    with small_batches(spark):
        vectors = rows.mapInArrow(_vectors(block.terms), "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")
        vectors = stage(vectors.filter("n > 0"), "vectors")
    n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
    held = vectors.filter(F.size("terms") > 0)
    weights = np.zeros(max(1, len(block.terms)), np.int64)
    for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the terms of the block
        weights[term] = weight(n_docs, df)
    found = held.mapInArrow(_search_task(block.counts, weights, n_docs, length or 1, k), "slot int, doc_id bigint, score bigint")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ids = F.array(*[F.lit(i).cast(id_type) for i in block.ids])  # at most BLOCK_ITEMS
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        ids[F.col("slot")].alias("item_id"), "rank", "doc_id", "score"
    )


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents with a score above 0 of each row of ``items``, ranks from 1.

    Items come through the driver in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_TERMS`` different terms (an item with more terms is
    a block of its own); documents are read once for each block. Equal scores go by ascending id, documents without an id last.

    Null and empty texts have no terms: such documents are not counted, such items have no rows. Repeated documents are ranked one by one,
    repeated items each have their own ranks, and a null item id stays null. Empty tables give an empty one. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    asked = items.select(F.col(item_id_col), F.col(item_text_col).cast("string"))
    id_type = asked.schema[0].dataType.simpleString()
    parts = [_ranked(rows, block, id_type, k) for block in item_blocks(map(tuple, asked.toLocalIterator()))]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionAll, parts)
