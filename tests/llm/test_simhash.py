"""SimHash and bit-sliced comparison against plain code."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm.awkward import ROWS, awkward_documents, rows_of, words_of

from gradeline.llm import simhash_dedup
from gradeline.llm.queries import QUERIES

CLASHES = ["fp", "u", "v", "block", "key", "component_id", "fingerprint", "a.b"]


def plain_fingerprint(text):
    w = words_of(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)] += [i] if i is not None else []
    return sorted(((i, f"{prints[k]:016x}", min(least[find(k)], default=None)) for k, (i, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(df)), key=str)


def test_equals_brute_force_on_awkward_rows(spark):
    docs = awkward_documents(spark, CLASHES)
    assert result(simhash_dedup.simhash_duplicates(docs)) == plain_components(ROWS)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert result(QUERIES["op12_simhash_bit_sliced"](spark, sf_dir)) == plain_components([tuple(r) for r in docs])


def test_empty_table(spark):
    found = simhash_dedup.simhash_duplicates(awkward_documents(spark, CLASHES).limit(0))
    assert found.columns == ["doc_id", "fingerprint", "component_id"] and found.count() == 0


def test_rows_without_an_id_only(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id bigint, text string")
    assert [r["component_id"] for r in rows_of(simhash_dedup.simhash_duplicates(docs))] == [None, None]


@pytest.mark.parametrize("radius", range(5))
def test_within_equals_plain_distances(radius):
    rng = np.random.default_rng(radius)
    left = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    right = left[:130].copy()
    for k in range(130):
        for bit in rng.choice(64, k % 7, replace=False):
            right[k] ^= np.uint64(1) << np.uint64(bit)
    i, j = simhash_dedup.within(left, right, radius)
    want = {(x, y) for x in range(150) for y in range(130) if (int(left[x]) ^ int(right[y])).bit_count() <= radius}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)


def test_counter_never_wraps_back_into_the_radius():
    every = np.array([0, 2**64 - 1] + [(1 << k) - 1 for k in range(1, 64)], np.uint64)
    i, j = simhash_dedup.within(every, every, 2)
    want = {(x, y) for x in range(65) for y in range(65) if (int(every[x]) ^ int(every[y])).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("block", [3, 16])
def test_one_key_over_many_blocks(spark, monkeypatch, block):
    """Thousands of fingerprints that agree in half of their bits: every pair of blocks is compared, and links reach across them."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rng = random.Random(block)
    prints = {(7 << 40) | rng.getrandbits(9) for _ in range(70)} | {rng.getrandbits(62) for _ in range(40)}
    links = simhash_dedup.links_within(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    found = [(r["u"], r["v"]) for r in rows_of(links)]
    assert all((u ^ v).bit_count() <= 2 and u != v for u, v in found)

    def groups(pairs):
        parent = {p: p for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in pairs:
            parent[find(u)] = find(v)
        out = defaultdict(set)
        for p in prints:
            out[find(p)].add(p)
        return sorted(map(sorted, out.values()))

    assert groups(found) == groups((u, v) for u in prints for v in prints if (u ^ v).bit_count() <= 2)


def test_spanning_keeps_fewer_links_than_nodes():
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 300, (2, 5000))
    a, b = simhash_dedup.spanning(300, u, v)
    assert len(a) < 300 and len(simhash_dedup.spanning(300, a, b)[0]) == len(a)
    label = np.arange(300)
    for x, y in list(zip(a, b)) * 300:
        label[x] = label[y] = min(label[x], label[y])
        if (label[a] == label[b]).all():
            break
    assert (label[u] == label[v]).all()


def test_hot_fingerprint_and_radius_check(spark):
    docs = spark.createDataFrame([(k, "same words in all of them") for k in range(3000)] + [(5000, "other")], "doc_id bigint, text string")
    found = simhash_dedup.simhash_duplicates(docs)
    assert {(r["component_id"], r["n"]) for r in found.groupBy("component_id").count().withColumnRenamed("count", "n").collect()} == {(0, 3000), (5000, 1)}
    with pytest.raises(ValueError):
        simhash_dedup.links_within(found, radius=7)
