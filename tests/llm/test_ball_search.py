"""Exact ball-tree search against plain scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.awkward import ROWS, UPPER, awkward_documents, rows_of

from gradeline.llm import ball_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASHES = ["n", "terms", "tfs", "slot", "score", "rank", "item_id", "a.b"]
ITEMS = [
    (1, "w1 w2 w3 w2 w2"), (2, "W7 unknown, é語😀 tail"), (3, None), (4, ""), (5, "..."), (6, "one two three"), (None, "w5 w6"),
    (1, "w1 w2 w3 w2 w2"), (7, " ".join(f"w{k}" for k in range(300))), (8, "two\xa0three \x85"), (9, "extra"), (10, "AB ab Ab"),
]


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_ranks(docs, items, k=10):
    found = [(i, plain_terms(t)) for i, t in docs]
    found = [(i, Counter(t), len(t)) for i, t in found if t]
    n_docs, length, df = len(found), sum(n for _, _, n in found), Counter(t for _, tf, _ in found for t in tf)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, tf, n in found:
            m = 25 + 75 * n * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in plain_terms(text) if t in tf
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if no_id else i, -s) for r, (s, no_id, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows_of(df)), key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("block_items, block_terms", [(256, 4096), (2, 4096), (256, 3)])
def test_equals_brute_force(spark, items, monkeypatch, block_items, block_terms):
    monkeypatch.setattr(ball_search, "BLOCK_ITEMS", block_items)
    monkeypatch.setattr(ball_search, "BLOCK_TERMS", block_terms)
    docs = awkward_documents(spark, CLASHES)
    assert result(ball_search.ranked_search(docs, items)) == plain_ranks(ROWS, ITEMS)


def test_empty_tables(spark, items):
    docs = awkward_documents(spark, CLASHES)
    for found in (ball_search.ranked_search(docs.limit(0), items), ball_search.ranked_search(docs, items.limit(0))):
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
    assert ball_search.ranked_search(docs.filter("text IS NULL"), items).count() == 0


def test_ids_of_items_keep_their_type(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d e")], "doc_id bigint, text string")
    named = spark.createDataFrame([("x", "a"), ("y", "d")], "item_id string, text string")
    assert sorted((r["item_id"], r["doc_id"]) for r in rows_of(ball_search.ranked_search(docs, named))) == [("x", 1), ("y", 3)]


def vectors(rng, n, n_terms, clusters):
    """Sparse rows in clusters, some of them copies, some empty."""
    centres = [sorted(rng.sample(range(n_terms), rng.randrange(0, 9))) for _ in range(clusters)]
    rows, columns, values = [], [], []
    for k in range(n):
        for c in set(rng.choice(centres) + ([rng.randrange(n_terms)] if rng.random() < 0.5 else [])):
            rows.append(k), columns.append(c), values.append(rng.randrange(1, 10**9))
    return np.array(rows), np.array(columns), np.array(values)


@pytest.mark.parametrize("seed", range(8))
def test_bounds_hold_and_search_is_exact(seed):
    rng = random.Random(seed)
    n, n_terms = rng.choice([1, 5, 17, 300]), 60
    rows, columns, values = vectors(rng, n, n_terms, 6)
    dense = np.zeros((n, n_terms), object)
    dense[:] = 0
    dense[rows, columns] = values.tolist()
    queries = np.array([[rng.choice([0, 0, 0, 1, 3]) for _ in range(n_terms)] for _ in range(12)], np.int64)
    exact = np.array([[sum(int(q) * x for q, x in zip(query, row)) for row in dense] for query in queries])
    tree = ball_search.BallTree(rows, columns, values, n, n_terms, leaf=4)
    bounds = tree.bounds(queries.astype(float))
    for node, (a, b) in enumerate(tree.ranges):
        assert b > a and (bounds[node] >= exact[:, tree.order[a:b]].max(axis=1)).all()
        if node >= tree.n_inner:
            assert all((tree.scores(node, q) == e[tree.order[a:b]]).all() for q, e in zip(queries, exact))
    best = [ball_search.Best(3) for _ in queries]
    ball_search.search(tree, list(range(n)), queries, best)
    for mine, e in zip(best, exact):
        want = sorted(((int(s), i) for i, s in enumerate(e) if s > 0), key=lambda x: (-x[0], x[1]))[:3]
        assert sorted(mine.documents(), key=lambda x: (-x[0], x[1])) == want


def test_subtrees_are_left_out():
    """Tight clusters and items that belong to one: most documents are never scored."""
    rng = random.Random(1)
    rows, columns, values = [], [], []
    for k in range(1024):
        for c in range(8):
            rows.append(k), columns.append(k // 64 * 8 + c), values.append(10**6 + rng.randrange(1000))
    queries = np.zeros((16, 128), np.int64)
    for c in range(16):
        queries[c, c * 8 : c * 8 + 8] = 1
    tree = ball_search.BallTree(np.array(rows), np.array(columns), np.array(values), 1024, 128)
    best = [ball_search.Best(10) for _ in queries]
    assert ball_search.search(tree, list(range(1024)), queries, best) < 16 * 1024 * 0.08
    assert all(i // 64 == c for c, mine in enumerate(best) for _, i in mine.documents())
