"""Every operator against a brute-force version, on small tables with awkward rows."""

import base64
import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from gradeline.llm import (
    byte_bpe, components, compression, fingerprints, html_extract, minhash_dedup, mixing, pii, sharding, toxicity, warc,
)
from gradeline.llm.queries import PATTERN, QUERIES, VOCABULARY
from gradeline.sources.workspace import fresh_path

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that operators use inside, or return.
CLASHES = "node key size tokens shard slot kept verdict text_crc32 range at places row t __index".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def shingle_set(text, width):
    w = words_of(text)
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def prose(rng, n):
    """Words of syllables, a few of them often and most seldom, as in a language."""
    syllables = [a + b for a in "bcdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "on", "st")]
    own = random.Random(1)
    vocabulary = ["".join(own.choice(syllables) for _ in range(own.choice([1, 2, 2, 3, 3, 4]))) for _ in range(4000)]
    return " ".join(vocabulary[int(4000 * rng.random() ** 2.5)] for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Copies, near copies, chains, nulls, empty, odd white space and characters, a long text, repeated rows, clashing columns."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    rows = [(1, base), (2, base), (3, base.upper()), (4, base + " extra"), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "One"),
            (10, "one\x1ctwo\xa0three four"), (11, "é" * 30 + " 語 😀 \x00 tail"), (None, base), (None, None), (12, sentence(rng, 20_000))]
    chain = base.split()
    for k in range(13, 40):
        chain = chain[:]
        chain[rng.randrange(len(chain))] = f"c{k}"
        rows.append((k, " ".join(chain)))
    rows += [(k, sentence(rng, rng.randrange(1, 80))) for k in range(40, 80)]
    rows += [(k, base) for k in range(80, 120)] + [(79, sentence(rng, 30)), (1, base), (41, "another text under a used id")]
    out = [(i, t, "en", None if (i or 0) % 11 == 3 else f"s{min((i or 0) % 7, 3)}", len(t or "")) for i, t in rows]
    frame = spark.createDataFrame(out, DOCS).repartition(5)
    return frame.withColumns({c: F.lit(-1) for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# near-duplicates


def brute_components(rows, width):
    sets = [shingle_set(t, width) if i is not None else frozenset() for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least[find(k)], i)
    return Counter(
        (i, len(shingle_set(t, width)), least[find(k)] if i is not None else None, i is None or least[find(k)] == i)
        for k, (i, t) in enumerate(rows)
    )


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(awkward, width):
    found = rows_of(minhash_dedup.near_duplicates(awkward, width=width))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found)
    assert got == brute_components([(r["doc_id"], r["text"]) for r in rows_of(awkward)], width)


def test_links_beside_the_hub_are_found(spark, monkeypatch):
    """Clusters that share bands with a common hub but reach each other only past it, over several blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_SETS", 7)
    rng = random.Random(3)
    hub = [f"h{k}" for k in range(100)]
    rows = [(0, " ".join(hub))]
    for cluster in range(12):
        own = hub[:]
        for k in rng.sample(range(100), 9):
            own[k] = f"x{cluster}.{k}"
        for copy in range(4):
            text = own[:]
            text[rng.randrange(100)] = f"y{cluster}.{copy}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(minhash_dedup.near_duplicates(df, width=2)))
    assert got == brute_components(rows, 2)


def test_minimum_and_maximum_estimate_without_bias():
    rng = np.random.default_rng(1)
    a, b = minhash_dedup.permutations(512)
    for share in (0.2, 0.5, 0.8, 0.95):
        x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        n = round(1000 * share)
        own = round((1000 - n) / 2)
        left, right = np.concatenate([x[:n], x[1000 : 1000 + own]]), np.concatenate([x[:n], x[1500 : 1500 + own]])
        same = minhash_dedup.min_max(left, a, b) == minhash_dedup.min_max(right, a, b)
        assert abs(same.mean() - n / (n + 2 * own)) < 0.06


def test_shared_counts_equal_set_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 4000))) for _ in range(9)]
    want = [[len(np.intersect1d(x, y)) for y in sets[4:]] for x in sets[:4]]
    assert minhash_dedup._shared(sets[:4], sets[4:]).tolist() == want


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500)]
    links += [(600, k) for k in range(601, 640)]
    got = {r["node"]: r["root"] for r in rows_of(components.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b"))}
    root = {x: x for pair in links for x in pair}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != 500}


def test_drop_near_duplicates_keeps_all_columns(awkward):
    kept = rows_of(minhash_dedup.drop_near_duplicates(awkward, width=2))
    want = Counter(r["doc_id"] for r in rows_of(minhash_dedup.near_duplicates(awkward, width=2)) if r["kept"])
    assert Counter(r["doc_id"] for r in kept) == want
    assert list(kept[0]) == awkward.columns


def test_a_used_id_with_another_text_is_judged_on_its_own(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text it is"), (2, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("text_key", F.lit(1))
    assert sorted(r["text"] for r in rows_of(minhash_dedup.drop_near_duplicates(df))) == ["a b c d e f g", "quite another text it is"]


# mixing


def test_mixture_equals_brute_force(awkward):
    got = rows_of(mixing.mix(awkward, max_repetition=3.0, block_tokens=4000))
    docs = [(r["doc_id"], r["source"], max(1, -(-len((r["text"] or "").encode()) // 4))) for r in rows_of(awkward)]
    total = Counter()
    for _, source, n in docs:
        total[source] += n
    top, low = max(total.values()), min(total.values())
    exponent = got[0]["exponent"]
    assert (top / low) ** (1 - exponent) <= 3.0 + 1e-6 and (exponent == 0 or (top / low) ** (1 - exponent + 1e-6) > 3.0)
    mass = sum((t / top) ** exponent for t in total.values())
    weight = {s: (t / top) ** exponent / mass for s, t in total.items()}
    spent = round(top * mass)
    blocks = max(1, -(-spent // 4000))

    def number(*parts):
        return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:15], 16)

    want = Counter()
    for source in total:
        quota = round(weight[source] * spent)
        at = 0
        for epoch in range(max(1, -(-quota // total[source]))):
            own = [(number("0", str(epoch), "" if i is None else str(i)), -1 if i is None else i, n, i) for i, s, n in docs if s == source]
            for _, _, n, i in sorted(own, key=lambda x: x[:3]):
                if at < quota:
                    want[i, source, n, epoch, at * blocks // quota] += 1
                at += n
    assert Counter((r["doc_id"], r["source"], r["tokens"], r["epoch"], r["block"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["block"]].append(r["slot"])
        assert abs(r["weight"] - weight[r["source"]]) < 1e-9
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["doc_id"], r["source"]) for r in got} == {(i, s) for i, s, _ in docs}


def test_mixture_meets_entropy_and_budget(spark):
    rows = [(k, f"s{min(k % 16, 5)}", 1 + k % 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint").withColumn("text", F.lit("x"))
    for target in (0.8, 1.5, 1.7):
        got = rows_of(mixing.mix(df, tokens=F.col("n"), target_entropy=target, budget=20_000))
        weight = {r["source"]: r["weight"] for r in got}
        spent = Counter()
        for r in got:
            spent[r["source"]] += r["tokens"]
        entropy = -sum(w * np.log(w) for w in weight.values())
        assert abs(sum(weight.values()) - 1) < 1e-9 and (abs(entropy - target) < 1e-5 or got[0]["exponent"] == 1 and entropy > target)
        assert all(-1 < spent[s] - weight[s] * 20_000 < 4 for s in weight)


def test_a_large_source_is_walked_in_parts(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source", "'abcdefgh' AS text")
    whole = Counter(map(str, rows_of(mixing.mix(df))))
    monkeypatch.setattr(mixing, "PART_TOKENS", 100)
    assert Counter(map(str, rows_of(mixing.mix(df)))) == whole


def test_mixed_documents_come_as_often_as_placed(awkward):
    placed = Counter(r["doc_id"] for r in rows_of(mixing.mix(awkward, max_repetition=3.0)))
    out = mixing.mixed_documents(awkward, max_repetition=3.0)
    assert out.columns == awkward.columns
    got = Counter(r["doc_id"] for r in rows_of(out))
    # rows that are equal in id and size to the last one taken count as it does
    assert got.keys() == placed.keys() and sum((got - placed).values()) <= 4 and not placed - got


# quality


def test_mixed_documents_lie_in_blocks_and_slots(awkward):
    options = {"max_repetition": 2.0, "block_tokens": 64}
    awkward = awkward.withColumn("n", mixing.text_tokens(F.col("text"))).dropDuplicates(["doc_id", "n"]).drop("n").cache()
    placed = rows_of(mixing.mix(awkward, **options).orderBy("block", "slot"))
    assert len({r["block"] for r in placed}) > 20
    got = [(r["doc_id"], r["source"], max(1, -(-len((r["text"] or "").encode()) // 4))) for r in rows_of(mixing.mixed_documents(awkward, **options))]
    assert got == [(r["doc_id"], r["source"], r["tokens"]) for r in placed]


def brute_quality(text, bands):
    text = text or ""
    w = WORD.findall(text)
    count = Counter(zip(w, w[1:], w[2:]))
    repeated = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    data = text.encode()

    def ratio(x):
        return len(x) / len(zstandard.ZstdCompressor(level=bands.level).compress(x)) if x else 0.0

    beyond = sum(b > 127 for b in data) > bands.most_beyond * len(data)
    whole = bands.other_limits if beyond else bands.limits
    of_chunk = bands.other_chunk_limits if beyond else bands.chunk_limits

    def holds(x, limits):
        least, most = [limit[1:] for limit in limits if len(x) >= limit[0]][-1]
        return least <= ratio(x) <= most

    parts = [data[k : k + bands.chunk] for k in range(0, len(data), bands.chunk)] if len(data) > bands.chunk else []
    bad = sum(not holds(p, of_chunk) for p in parts)
    verdict = "base" if failed else "whole" if not holds(data, whole) else "chunks" if bad > bands.bad_share * len(parts) else "kept"
    return (
        len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), duplicates, len(repeated), failed,
        round(ratio(data), 9), len(parts), bad, verdict, verdict == "kept",
    )


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    noise = base64.b64encode(rng.randbytes(30_000)).decode()
    spaced = " ".join(noise[k : k + 7] for k in range(0, len(noise), 7))
    clean = prose(rng, 3000)
    rows = ["a a a a b", "one line\none line\n\n \none line", "a # * $ % & | < >", clean, spaced, noise, clean[:9000] + spaced[:9000],
            "say it again " * 60, "\n".join([clean[:300]] * 40), prose(rng, 49), prose(rng, 50), "x" * 100_000, None, ""]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")


def test_compression_quality_equals_brute_force(awkward, texts):
    for df in (awkward, texts):
        got = rows_of(compression.compression_quality(df))
        want = Counter((r["doc_id"], *brute_quality(r["text"], compression.BANDS)) for r in rows_of(df))
        assert Counter((*list(r.values())[:7], round(r["ratio"], 9), *list(r.values())[8:]) for r in got) == want
    verdicts = {r["doc_id"]: r["verdict"] for r in rows_of(compression.compression_quality(texts))}
    assert verdicts[3] == verdicts[10] == "kept" and verdicts[4] == "whole" and verdicts[6] in ("whole", "chunks")
    assert verdicts[7] == verdicts[12] == verdicts[13] == "base"


def test_rejected_documents_go(awkward, texts):
    awkward = awkward.unionByName(texts, allowMissingColumns=True)
    want = Counter(r["doc_id"] for r in rows_of(compression.compression_quality(awkward)) if r["kept"])
    out = compression.drop_rejected(awkward)
    assert out.columns == awkward.columns and Counter(r["doc_id"] for r in rows_of(out)) == want and want


def test_a_bad_part_of_a_long_text_is_found(spark):
    rng = random.Random(17)
    clean = prose(rng, 9000)[:45_000]
    noise = base64.b64encode(rng.randbytes(40_000)).decode()
    spaced = " ".join(noise[k : k + 8] for k in range(0, len(noise), 8))
    rows = [clean, clean[:20_481], clean[:4097], clean[:2000], clean[:900]]
    for length in (45_000, 5000):
        for share in (0.2, 0.45):
            n = max(2100, int(length * share))
            for junk in (spaced, "buy it now and here " * 1000):
                rows += [clean[: length - n] + junk[:n], clean[: length // 5] + junk[:n] + clean[length // 5 : length - n]]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in rows_of(compression.compression_quality(frame))}
    assert all(got[k]["kept"] and got[k]["n_bad_chunks"] == 0 for k in range(5))
    assert all(not got[k]["kept"] and 0 < got[k]["n_bad_chunks"] <= 1 + got[k]["n_chunks"] // 2 for k in range(5, len(rows)))
    assert sorted(r["doc_id"] for r in rows_of(compression.drop_rejected(frame))) == list(range(5))


def test_symbols_on_words_and_other_scripts(spark):
    """Words with the same few symbols lie above the band of prose; scripts with long characters have bands of their own."""
    rng = random.Random(23)
    rows = []
    for n in (200, 400, 1500, 6000):
        words = prose(rng, n).split()
        rows.append(" ".join(w + rng.choice(["$$$", "###", "%%%", "&&&"]) for w in words))
    rows.append(" | ".join(prose(rng, 1500).split()))
    han = "".join(chr(0x4E00 + int(2500 * rng.random() ** 2)) for _ in range(9000))
    greek = prose(rng, 1500).translate({ord(c): ord(c) - ord("a") + 0x3B1 for c in "abcdefghijklmnopqrstuvwxy"})
    rows += [" ".join(han[k : k + 9] for k in range(0, len(han), 9)), greek, greek[:700], prose(rng, 1500)]
    got = rows_of(compression.compression_quality(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")))
    assert [r["kept"] for r in sorted(got, key=lambda r: r["doc_id"])] == [False] * 5 + [True] * 4


def test_bands_tell_labelled_documents_apart(spark):
    """Ids that the limits were not chosen on. No label is read by the operator."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("needs the table with labels of 10,000 documents")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    found = compression.compression_quality(docs).filter("NOT base_failed AND doc_id % 2 = 1").join(labels, "doc_id")
    share = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[0] <= 0.2 and share[1] >= 0.98


def test_clean_texts_of_the_documents_table_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = rows_of(compression.compression_quality(docs).filter("n_chunks > 0"))
    clean = [r for r in long if not r["base_failed"] and r["verdict"] != "whole"]
    assert clean and all(r["kept"] for r in clean)


# sharding


def least_capacity(sizes, n):
    def fits(capacity):
        shards, load = 1, 0
        for s in sizes:
            shards, load = (shards, load + s) if load + s <= capacity else (shards + 1, s)
        return shards <= n

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("parts", [10_000, 3])
def test_shards_are_minimax_and_gapless(awkward, monkeypatch, parts):
    monkeypatch.setattr(sharding, "ROWS_IN_ORDER", parts)
    got = rows_of(sharding.shard_documents(awkward, 7))
    docs = rows_of(awkward)
    encoded = [(r["doc_id"], (r["text"] or "").encode()) for r in docs]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in encoded)
    shard_of, loads, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        shard_of[r["text_crc32"], r["size"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    hashed = awkward.selectExpr("shiftrightunsigned(xxhash64(xxhash64(coalesce(text, ''))), 48) AS atom", "octet_length(coalesce(text, '')) + 8 AS size")
    sizes = [r["size"] for r in hashed.groupBy("atom").agg(F.sum("size").alias("size")).orderBy("atom").collect()]
    assert max(loads.values()) == least_capacity(sizes, 7)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


@pytest.mark.parametrize("n", [1, 2, 5, 24])
def test_smallest_capacity(spark, n):
    rng = random.Random(n)
    for _ in range(5):
        sizes = [rng.choice([1, 5, 50, 500]) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))]
        df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "atom int, bytes bigint").agg(
            F.array_sort(F.collect_list(F.struct("atom", "bytes"))).alias("atoms"), F.sum("bytes").alias("total"), F.max("bytes").alias("largest")
        )
        assert df.select(F.expr(sharding.smallest_capacity(n))).first()[0] == least_capacity(sizes, n)


@pytest.mark.parametrize("n", [1, 2, 5, 24])
def test_cuts_fill_all_shards_within_the_capacity(spark, n):
    rng = random.Random(40 + n)
    tables = [[rng.choice([1, 5, 50, 500]) * rng.randrange(0, 9) for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    tables += [[9] * 30, [0] * 30, [500] + [1] * 40, [1] * 40 + [500], [500, 1, 500, 1, 500] * 6]
    for sizes in tables:
        df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "atom int, bytes bigint").agg(
            F.array_sort(F.collect_list(F.struct("atom", "bytes"))).alias("atoms"), F.sum("bytes").alias("total")
        ).withColumn("capacity", F.lit(least_capacity(sizes, n)).cast("bigint"))
        cuts = df.select(F.expr(sharding._cuts(n))).first()[0]
        bounds = [0, *cuts, len(sizes)]
        shards = [sizes[a:b] for a, b in zip(bounds, bounds[1:])]
        assert bounds == sorted(set(bounds)) and len(shards) == min(n, len(sizes))
        assert max(map(sum, shards)) == least_capacity(sizes, n)


def test_a_group_of_a_third_leaves_the_other_shards_even(spark):
    rng = random.Random(24)
    texts = [sentence(rng, 20) for _ in range(6000)]
    rows = list(enumerate(texts + ["one text for a third of all rows " * 3] * 3000))
    loads = Counter()
    for r in rows_of(sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 24)):
        loads[r["shard"]] += r["size"]
    *others, top = sorted(loads.values())
    assert len(loads) == 24 and top > sum(loads.values()) / 4 and others[-1] < 1.1 * others[0]


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(4)
    pieces = ["a@b.co", "x.y+z@mail-1.example.com", "@", "a@b", "é", "😀", " ", "\n", ".", "-", "+", "1", "23", "456", "255", "256", "007.1.2.3",
              "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "4242424242424242", "+1 (212) 555-0100",
              "+49 30 901820", "+4111111111111111", "(", ")", "_", "word", "IBAN ", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432",
              "ssn ", "123-45-6789", "000-12-3456", "a@b.co_c@d.ee", "1.2.3.4@x.yz", "+1-4111111111111"]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    rows += [None, "", "9" * 60_000, "a" * 60_000 + "@", "1." * 30_000, "+" * 50_000, "+1" + " " * 50_000, "0 " * 30_000, "a@" + "b." * 30_000, "x@y." * 5000,
             "A" * 30_000, "AB12 " * 8000, "1-" * 30_000]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(8).cache()


def test_base_spans_equal_brute_force(awkward, private):
    for df in (awkward, private):
        texts = Counter((r["doc_id"], hashlib.sha256(",".join(brute_spans(r["text"])).encode()).hexdigest()) for r in rows_of(df))
        got = rows_of(pii.personal_data(df))
        assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == texts
        for r in got:
            kinds = Counter(s.split(":")[0] for s in r["spans"].split(",") if s)
            assert all(r[f"n_{k.name}"] == kinds[k.name] for k in pii.KINDS) and len(r["scores"].split(",")) == max(1, sum(kinds.values()))


def test_checksums_and_context_decide(spark):
    cases = {
        "pay to DE89 3704 0044 0532 0130 00 now": "iban:7:34", "pay to DE88 3704 0044 0532 0130 00 now": "",
        "GB82WEST12345698765432": "iban:0:22", "no 123-45-6789 here": "", "my SSN 123-45-6789": "ssn:7:18",
        "my ssn 000-45-6789": "", "card 4111 1111 1111 1111": "card:5:24", "card 4111 1111 1111 1112": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    assert [r["spans"] for r in sorted(rows_of(pii.personal_data(df)), key=lambda r: r["doc_id"])] == list(cases.values())
    near = rows_of(pii.personal_data(spark.createDataFrame([(1, "call +1 212 555 0100"), (2, "at +1 212 555 0100")], "doc_id bigint, text string")))
    assert {r["doc_id"]: r["scores"] for r in near} == {1: "0.85", 2: "0.60"}


def test_redaction_covers_all_spans(private, awkward):
    spans = {r["doc_id"]: r["spans"] for r in rows_of(pii.personal_data(private))}
    got = {r["doc_id"]: r["text"] for r in rows_of(pii.redact(private))}
    for r in rows_of(private):
        marks = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[r["doc_id"]].split(",") if s))
        text, out, at = r["text"], "", 0
        for start, end, kind in marks:
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert got[r["doc_id"]] == (out + text[at:] if marks else text)
    assert pii.redact(awkward).columns == awkward.columns


def test_texts_with_many_spans(spark):
    """Positions and masks across the borders of the blocks in which they are added up."""
    rng = random.Random(8)
    forms = ["é a@b{}.co", "1.2.3.4@x{}.yz ", "no 4111 1111 1111 1111 {}\n", "+49 30 90{:05d} 😀", "x 300.1.1.{} y", "4111 1111 1111 1112 10.0.0.1"]
    texts = ["".join(rng.choice(forms).format(i % 90) for i in range(n)) for n in (1, 255, 256, 257, 511, 512, 513, 1500)]
    texts += [" ".join(f"a{i}@b.co" for i in range(n)) for n in (255, 256, 257, 1025)]
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    test_redaction_covers_all_spans(many, many)
    got = {r["doc_id"]: r["base_sha256"] for r in rows_of(pii.personal_data(many))}
    assert got == {i: hashlib.sha256(",".join(brute_spans(t)).encode()).hexdigest() for i, t in enumerate(texts)}


def test_spans_of_one_text_cost_linear_time(spark):
    def seconds(n):
        text = " ".join(f"user{i}@example.org" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1)
        began = time.perf_counter()
        assert rows_of(pii.personal_data(df))[0]["n_email"] == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(64_000) < 8 * max(seconds(16_000), 1.0)  # 16 if quadratic


# toxicity


def test_toxicity_is_learnt_without_held_out_labels(spark):
    rng = random.Random(8)
    clean = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        if toxic:
            bad = ["idiot", "m0r0n", "zlorgish", "zlorgen"]
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad[:2] if k % 10 else bad[2:]))
        docs.append((k, " ".join(w)))
        # labels of held-out rows are turned round: nothing may be learnt from them
        turned = zlib.crc32(str(k).encode()) % 3 == 1
        labels.append((k, int(toxic != turned), -1))
    docs += [(None, "idiot"), (9000, None), (9001, ""), (7, docs[7][1])]
    labels += [(None, 1, 0), (3, None, 0), (77_777, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("features", F.lit(1)).withColumn("label", F.lit(2))
    lb = spark.createDataFrame(labels, "doc_id bigint, toxic int, text int")
    got = rows_of(toxicity.toxicity(df, lb))
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    ids = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] < 9000}
    wrong = [k for k, r in ids.items() if r["predicted"] != (k % 5 == 0)]
    assert len(wrong) <= 15
    assert all(ids[k]["predicted"] == 0 for k in ids if k % 5) and ids[9000 - 8999]["predicted"] == 0


def test_toxicity_without_usable_labels(spark, empty):
    lb = spark.createDataFrame([], "doc_id bigint, toxic int")
    df = spark.createDataFrame([(1, "idiot"), (2, None)], "doc_id bigint, text string")
    assert [(r["score"], r["predicted"]) for r in rows_of(toxicity.toxicity(df, lb))] == [(0.0, 0)] * 2
    assert rows_of(toxicity.toxicity(empty, lb)) == []


@pytest.mark.parametrize("word,hidden", [("1d10t", True), ("idi*t", False), ("i.d.i.o.t", True), ("idiooooot", True), ("$tup1d!", True), ("idiot%%%", False)])
def test_disguised_words(word, hidden):
    found = toxicity.WordKinds({})[word]
    assert bool(found & toxicity.INSULT) == (word != "idi*t") and bool(found & toxicity.HIDDEN) == hidden


# fingerprints


def exact(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("ranges", [1, 4, 300])
def test_fingerprints_of_neighbours(awkward, ranges):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in rows_of(awkward)), key=lambda x: (x[0] is not None, x[0], x[1]))
    got = rows_of(fingerprints.compare_with_next(awkward, ranges=ranges))
    want, near = Counter(), {}
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want[i, len(text), digest] += 1
        sets = [shingle_set(t, 5) for t in (text, edited, following)]
        near[i, len(text), digest] = exact(*sets[:2]), exact(sets[0], sets[2]), max(map(len, sets))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    for r in got:
        edited, following, size = near[r["doc_id"], r["n_chars"], r["edited_sha256"]]
        allowed = 1e-9 if size < 64 else 0.25
        assert abs(r["near_edited"] - edited) <= allowed and abs(r["near_next"] - following) <= allowed
    same = defaultdict(set)
    texts = {i: t for i, t in docs if i is not None and i not in (1, 41, 79)}
    for r in got:
        if r["doc_id"] in texts:
            same[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(s) == 1 for s in same.values())


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(6)
    w = [f"v{k}" for k in range(30_000)]
    rng.shuffle(w)
    hashes = fingerprints.WordHashes()
    left, right = " ".join(w[:20_000]), " ".join(w[10_000:])
    a, b = (fingerprints.sketch(hashes, t, 1, 1024) for t in (left, right))
    assert abs(fingerprints.resemblance(a, b, 1024) - 1 / 3) < 0.06 and abs(fingerprints.containment(a, b, 1024) - 0.5) < 0.08
    assert abs(fingerprints.distinct_shingles(a, 1024) / 20_000 - 1) < 0.12
    assert (fingerprints.merge([a, b], 1024) == fingerprints.sketch(hashes, " ".join(w), 1, 1024)).all()
    assert (fingerprints.from_text(fingerprints.to_text(a)) == a).all()
    rows = [(k % 2 if k % 5 else None, " ".join(w[200 * k : 200 * k + 200])) for k in range(100)]
    df = spark.createDataFrame(rows, "source bigint, text string").repartition(6)
    merged = fingerprints.merge_sketches(df.withColumn("doc_id", F.lit(1)).select("source", "doc_id", "text").transform(
        lambda d: fingerprints.sketches(d.withColumn("doc_id", F.coalesce("source", F.lit(-1))), width=1)), "doc_id")
    for r in rows_of(merged):
        whole = " ".join(t for s, t in rows if (-1 if s is None else s) == r["doc_id"])
        assert r["sketch"] == fingerprints.to_text(fingerprints.sketch(hashes, whole, 1))


def test_repeated_values_do_not_shorten_a_sketch():
    values = np.concatenate([np.zeros(5000, np.uint64), np.arange(1000, dtype=np.uint64)])
    assert fingerprints.smallest(values, 128).tolist() == list(range(128))


# main text

LONG = "This sentence is long enough, has a comma or two, and reads like an article. "
PAGES = {
    "": "",
    "<p>a": "a",
    "plain &amp; simple &lt;b&gt; &am &copy;": "plain & simple <b> &am ©",
    f"<body><nav><p>{LONG}</p></nav><article><h1>T</h1><p>{LONG}<p>Very<b> </b>sh<i>ort</i>.<br>x</article><footer><p>{LONG * 3}</p></footer>":
        f"T {LONG}Very short. x",
    f"<main><header>no</header><article><header><h1>T</h1></header><p>{LONG}</p><ul><li>one<li>two</ul><form>f</form>"
    f"<div class='article-comments'>{LONG}</div><aside>z</aside></article></main>": f"T {LONG}one two",
    f"<div id=content class=has-sidebar><h1>H</h1><p>{LONG}</p></div><div id=sidebar><p>{LONG * 9}</p></div>": f"H {LONG}",
    f"<div class='cookie-notice'>{LONG * 3}</div><div><p>{LONG}</p><p>{LONG}</p></div>": f"{LONG}{LONG}",
    f"<div><p>{LONG}</p></div><div><p>{' '.join(['<a href=x>' + LONG + '</a>'] * 5)}</p></div>": f"{LONG}",
    f"<article><p>{LONG}</p><script>var x = '</p>';</script><!-- {LONG} --><style>p {{}}</style><p hidden>{LONG}</p><p>a\n\tb</p></art": f"{LONG}a b",
    "<article><p>1 < 2 and 3 > 2 &nbsp; <3</p></article>": "1 < 2 and 3 > 2 <3",
    f"<table><tr><td>{LONG}<td>{LONG}<tr><td>z</table>": f"{LONG}{LONG}z",
    f"<p title='a>b'>{LONG}</p>": LONG,
}


def test_main_text(spark):
    rows = [(k, None if not k else f"u{k}", page) for k, page in enumerate(PAGES)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    got = {r["page_id"]: r for r in rows_of(html_extract.extract_text(df))}
    for k, (page, want) in enumerate(PAGES.items()):
        assert (got[k]["text"], got[k]["n_chars"]) == (want.strip(), len(want.strip())), page
    assert got[None]["text"] == "" and got[None]["n_chars"] == 0 and len(got) == len(rows)


def test_long_and_deep_pages_end():
    assert html_extract.main_text("<div>" * 5000 + f"<p>{LONG}") == LONG.strip()
    assert html_extract.main_text(f"<p>{LONG}" * 3000) == (LONG * 3000).strip()
    assert html_extract.main_text("<" * 20_000).startswith("<<")


def test_articles_of_the_pages_table(spark, sf_dir):
    import html

    for r in rows_of(QUERIES["op8_html_main_text"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")):
        inside = r["html"].partition("<article>")[2].partition("</article>")[0]
        inside = re.sub(r"<[/a-z][^>]*$", "", re.sub(r"<[^>]*>", " ", inside))
        assert r["text"] == " ".join(html.unescape(inside).split())


# archives


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    big = "".join(chr(rng.choice([60, 62, 10, 13, 97, 233, 0x8A9E, 0x1F600])) for _ in range(200_000))
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = [None, "", "x", "a" * 999, "a" * 999, "a" * 1000, "a" * 1000, "é" * 500, "é" * 500, big, big, fake * 40, fake * 40, "\r\n\r\n", ">", "\r\n\r\n>",
              "b" * 3_000_000, "nul \x00 > <p>"]
    rows = [(k, None if k % 3 == 0 else f"http://x.y/{k} a\r\nb", b) for k, b in enumerate(bodies)] + [(5, "again", "a" * 1000), (None, "n", big), (None, None, "c" * 2000)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).repartition(3)


def test_archives_equal_brute_force(pages, sf_dir):
    want = Counter()
    rows = rows_of(pages)
    for r in rows:
        data = (r["html"] or "").encode()
        ids = [x["page_id"] for x in rows if (x["html"] or "").encode() == data and x["page_id"] is not None]
        revisit = len(data) >= 1000 and ids and r["page_id"] != max(ids)
        want[r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None] += 1
    got = rows_of(warc.archive_and_read(pages))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want


@pytest.mark.parametrize("chunk", [1, 1000, 1 << 20])
def test_chunks_are_bounded_and_carry_digests(spark, pages, chunk):
    few = pages.filter("length(coalesce(html, '')) < 3000 OR page_id = 10") if chunk > 1 else pages.filter("length(html) < 1200")
    path = fresh_path(spark, "test-archives")
    warc.write_archives(few, path)
    chunks = defaultdict(list)
    for r in rows_of(warc.read_chunks(spark, path, chunk)):
        chunks[r["record_id"], r["record_type"]].append(r)
    texts = {f"{warc.ID}{r['page_id'] if r['page_id'] is not None else ''}": (r["html"] or "").encode() for r in rows_of(few) if r["page_id"] != 5}
    for (record, kind), own in chunks.items():
        own.sort(key=lambda r: r["chunk_no"])
        if kind == "revisit" or record not in texts:
            continue
        data = b"".join(bytes(r["data"]) for r in own)
        assert data == texts[record]
        assert [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
        assert all(len(r["data"]) == chunk for r in own[:-1]) and len(own[-1]["data"]) <= chunk
        for r in own[:: max(1, len(own) // 20)]:
            assert r["digest"] == hashlib.sha1(data[: r["at"] + r["n_bytes"]]).hexdigest()


def test_broken_archives_are_errors():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 11\r\n\r\nHTTP\r\n\r\n"
    for data in (head + b"ab", head + b"abcXXXX", b"NOT/1.0\r\n\r\n", head):
        reader = warc.ArchiveReader("a", 10, True)
        with pytest.raises(ValueError):
            reader.feed(data)
            reader.close()
    for step in (1, 2, 3, 7, 1000):
        reader = warc.ArchiveReader("a", 10, True)
        data, rows = (head + b"abc\r\n\r\n") * 3, []
        for k in range(0, len(data), step):
            rows += reader.feed(data[k : k + step])
        reader.close()
        assert [bytes(r[8]) for r in rows] == [b"abc"] * 3


# byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_reference_encoder(awkward, reference):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(byte_bpe.round_trip(awkward, VOCABULARY, PATTERN)))
    want = Counter()
    for r in rows_of(awkward):
        ids = reference.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert got == want


def test_random_texts_and_offsets(reference):
    bpe = byte_bpe.tokenizer(VOCABULARY, PATTERN)
    rng = random.Random(1)
    pieces = ["a", "B", " ", "  ", "\n", "\t", "é", "語", "😀", "​", "\x1c", "\x85", "\xa0", "1", "²", "'s", "'LL", "!", "́", "﻿", "\x00", "Ⅷ", "<|endoftext|>", "the"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        ids = bpe.encode(text)
        assert ids == reference.encode_ordinary(text) and bpe.decode_bytes(ids) == text.encode()
        at = 0
        for i, (start, end) in zip(ids, zip(*bpe.offsets(text, ids))):
            own = bpe.bytes_of[i]
            covered = text[start:end].encode()
            assert own in covered and text.encode()[at : at + len(own)] == own
            assert len(text[:start].encode()) <= at and at + len(own) <= len(text[:end].encode())
            at += len(own)
    long = "x" * 30_000
    assert bpe.decode_bytes(bpe.encode(long)) == long.encode()


def test_encode_and_decode_tables(awkward):
    tokens = byte_bpe.encode(awkward, VOCABULARY, PATTERN)
    back = Counter((r["doc_id"], r["text"]) for r in rows_of(byte_bpe.decode(tokens, VOCABULARY, PATTERN)))
    assert back == Counter((r["doc_id"], r["text"] or "") for r in rows_of(awkward))
    half = awkward.sparkSession.createDataFrame([(1, byte_bpe.tokenizer(VOCABULARY, PATTERN).encode("😀")[:1]), (2, None)], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in rows_of(byte_bpe.decode(half, VOCABULARY, PATTERN))} == {1: "�", 2: ""}


def test_digests_are_of_the_decoded_texts(awkward):
    tokens = byte_bpe.encode(awkward, VOCABULARY, PATTERN)
    digests = Counter((r["doc_id"], r["decoded_sha256"]) for r in rows_of(tokens))
    assert digests == Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows_of(awkward))


# all


def test_empty_tables(spark, empty):
    nothing = spark.createDataFrame([], "page_id bigint, url string, html string")
    for df in (
        minhash_dedup.near_duplicates(empty), minhash_dedup.drop_near_duplicates(empty), mixing.mix(empty), mixing.mixed_documents(empty),
        compression.compression_quality(empty), compression.drop_rejected(empty), sharding.shard_documents(empty), pii.personal_data(empty),
        pii.redact(empty), fingerprints.compare_with_next(empty), html_extract.extract_text(nothing), warc.archive_and_read(nothing),
        byte_bpe.round_trip(empty, VOCABULARY, PATTERN),
    ):
        assert df.collect() == []


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op2_temperature_mixing", "op4_minimax_sharding", "op5_personal_data"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|MapPartitions|Cartesian", plan)


def test_no_operator_swallows_import_errors():
    folder = os.path.dirname(os.path.abspath(pii.__file__))
    for name in os.listdir(folder):
        if name.endswith(".py"):
            assert not re.search("except (Import|ModuleNotFound)Error", open(os.path.join(folder, name)).read())
