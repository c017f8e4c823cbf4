"""The corpus pipeline, stage by stage and as a whole, against a plain Python version."""

import hashlib
import random
from collections import Counter

import pytest
from test_llm_operators import CLASHES, DOCS, PATTERNS, brute_components, brute_quality, prose, reference, rows_of  # noqa: F401

import corpus_pipeline
from gradeline.llm import compression, pii
from gradeline.sources.workspace import fresh_path
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(13)
    clean = [prose(rng, 120) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100 + k, clean[k % 4]) for k in range(20)]
    for k in range(12):
        w = clean[5].split()
        w[rng.randrange(120)] = f"n{k}"
        rows.append((200 + k, " ".join(w)))
    rows += [(300, "buy now " * 90), (301, None), (302, ""), (303, "short"), (None, clean[7] + " tail"), (304, prose(rng, 120) + " mail a.b@c.de or +1 212 555 0100 now")]
    rows += [(400 + k, prose(rng, 400)) for k in range(6)] + [(404, rows[-1][1])]
    docs = [(i, t, "en", None if (i or 0) % 13 == 4 else "big" if (i or 0) < 300 else f"s{i % 3}", 0) for i, t in rows]
    path = fresh_path(spark, "pipeline-test")
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(-1) for c in CLASHES if c not in ("kept", "size")})
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def masked(text, spans):
    out, at = "", 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def brute_kept(docs):
    """Row by row, as a row with a used id is judged on its own text."""
    out = []
    for r in docs:
        least = r["doc_id"]
        if least is not None:
            found = brute_components([(x["doc_id"], x["text"]) for x in docs] + [(least + 10**9, r["text"])], 5)
            least = next(c for i, _, c, _ in found if i == least + 10**9)
        out.append(least == r["doc_id"])
    return out


def brute_copies(docs, limit=2.0):
    """How often each document comes: the largest source once, the others up to ``limit`` times, along a hashed walk."""
    size = lambda t: max(1, -(-len((t or "").encode()) // 4))
    total = Counter()
    for r in docs:
        total[r["source"]] += size(r["text"])
    top, low = max(total.values()), min(total.values())
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (top / low) ** (1 - mid) <= limit else (mid, hi)
    mass = sum((t / top) ** round(hi, 9) for t in total.values())
    copies = Counter()
    for source, t in total.items():
        quota = round(round((t / top) ** round(hi, 9) / mass, 12) * round(top * mass))
        at = 0
        for epoch in range(max(1, -(-quota // t))):
            def place(r, epoch=epoch):
                name = "" if r["doc_id"] is None else str(r["doc_id"])
                number = int(hashlib.md5(f"0:{epoch}:{name}".encode()).hexdigest()[:15], 16)
                return number, -(2**63) if r["doc_id"] is None else r["doc_id"], size(r["text"])

            own = sorted((r for r in docs if r["source"] == source), key=place)
            taken = [place(r) for r in own]
            last = None
            for r, p in zip(own, taken):
                if at < quota:
                    last = p
                at += p[2]
            for r, p in zip(own, taken):
                copies[r["doc_id"], r["text"]] += last is not None and p <= last
    return copies


def test_stages_and_run(spark, folder, reference):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, rows_of(docs)
    key = lambda rs: Counter((r["doc_id"], r["text"], r["source"]) for r in rs)
    frame = docs
    expected = [r for r in rows if brute_quality(r["text"], compression.BANDS)[-1]]
    for (name, function), step in zip(corpus_pipeline.STAGES, range(5)):
        frame = function(spark, frame, folder)
        if step == 4:
            break
        path = fresh_path(spark, "stage")
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        assert frame.columns == columns
        if step == 1:
            expected = [r for r, kept in zip(expected, brute_kept(expected)) if kept]
        elif step == 2:
            found = spark.createDataFrame([(k, r["text"]) for k, r in enumerate(expected)], "doc_id bigint, text string")
            spans = {r["doc_id"]: r["spans"] for r in rows_of(pii.personal_data(found))}
            expected = [r | {"text": masked(r["text"], spans[k])} for k, r in enumerate(expected)]
            assert any("[EMAIL]" in r["text"] and "[PHONE]" in r["text"] for r in expected)
        elif step == 3:
            once, copies = key(expected), brute_copies(expected)
            expected = [r for r in expected for _ in range(copies[r["doc_id"], r["text"]] // once[r["doc_id"], r["text"], r["source"]])]
            assert len(expected) > len(once)
        assert key(rows_of(frame)) == key(expected), name
    want = Counter((r["doc_id"], tuple(reference.encode_ordinary(r["text"]))) for r in expected)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows_of(frame)) == want
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows_of(corpus_pipeline.run(spark, folder))) == want


def test_stages_of_an_empty_table(spark):
    path = fresh_path(spark, "pipeline-empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and set(PATTERNS) == set(pii.BASE)
