import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from equigauge.llm import search
from equigauge.llm.search import Items, ranked, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def expected(items, docs, k):
    """(item row, rank, doc_id, score) by plain loops over all pairs."""
    counted = [(doc_id, Counter(words(text))) for doc_id, text in docs]
    counted = [(doc_id, c) for doc_id, c in counted if c]
    n_docs, every = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        scored = []
        for doc_id, c in counted:
            n = sum(c.values())
            m = 75 + (25 * n * n_docs) // every
            score = 0
            for term in words(text):
                if term in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(items[place][0], r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, items, docs, k=20, parts=3):
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string")
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, n int, length string, item int")
    return sorted((tuple(r) for r in ranked(i, d.repartition(parts), k).collect()), key=str)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_terms(text):
    assert [t.decode() for t in terms_of(text.encode())] == words(text)


@pytest.fixture
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.choice([3, 20, 80, 400]))) for i in range(900)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)]
    items = [(i, text(rng.choice([1, 4, 15, 40]))) for i in range(25)]
    docs += [(2000 + i, text(5) + " " + items[i][1] + ". " + text(10)) for i in range(25)]
    return items, docs


def test_against_all_pairs(spark, corpus, monkeypatch):
    items, docs = corpus
    want = expected(items, docs, 20)
    assert found(spark, items, docs) == want
    # Small buckets, few coordinates and several blocks give the same rows.
    monkeypatch.setattr(search, "BUCKET_ROWS", 16)
    monkeypatch.setattr(search, "BUCKET_TERMS", 200)
    monkeypatch.setattr(search, "FOCUS", 2)
    monkeypatch.setattr(search, "BLOCK_CHARS", 1500)
    assert found(spark, items, docs, parts=7) == want


def test_odd_rows(spark):
    long = "Zé9 " * 40_000
    docs = [
        (1, None), (2, ""), (3, " \t--"), (4, "alpha beta"), (5, "ALPHA beta"), (5, "alpha, Beta"), (None, "alpha beta"),
        (6, long), (7, "É é É"), (8, "a_b a"), (-(2**63), "gamma"), (2**63 - 1, "gamma"), (None, "gamma"), (None, None),
    ]
    items = [
        (1, "alpha beta"), (1, "alpha alpha"), (1, "alpha beta"), (None, "gamma"), (2, None), (3, ""), (4, "nowhere"),
        (5, "zé9 " * 3_000 + "é"), (6, "a b B"),
    ]
    assert found(spark, items, docs, k=3) == expected(items, docs, 3)
    assert found(spark, items, [], k=3) == []
    assert found(spark, [], docs, k=3) == []
    assert found(spark, [(1, None)], docs) == []


def test_bounds_spare_work(spark, corpus, monkeypatch):
    """Where a few long vectors hold the best documents, buckets and documents are left out."""
    items, docs = corpus
    block = Items([t for _, t in items])
    rng = np.random.default_rng(1)
    size, visited = len(block.vocabulary), []
    vectors = []
    for doc_id in range(5000):
        scale = 10_000 if doc_id < 200 else 100
        terms = np.sort(rng.choice(size, 12, replace=False))
        vectors.append((doc_id, terms, rng.integers(1, scale, 12)))
    vectors.sort(key=lambda v: -float((v[2].astype(float) ** 2).sum()))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([v[0] for v in vectors], pa.int64()),
            pa.array([math.sqrt(float((v[2].astype(float) ** 2).sum())) for v in vectors]),
            pa.array([v[1] for v in vectors], pa.list_(pa.int32())),
            pa.array([v[2] for v in vectors], pa.list_(pa.int64())),
        ],
        names=["doc_id", "length", "terms", "impacts"],
    )
    plain = search._Bucket.search
    monkeypatch.setattr(
        search._Bucket, "search", lambda self, item, *a: visited.append(len(self.ids)) or plain(self, item, *a)
    )
    best = search._Best(np.zeros(len(items), np.int64), 5)
    counts = np.zeros(size, np.int64)
    for bucket in search._buckets(iter([batch.slice(0, 1111), batch.slice(1111)])):
        reach = block.length * bucket.lengths.max() * search.UP
        for item in np.flatnonzero(reach >= best.floors):
            bucket.search(int(item), block.terms[item], block.times[item], best, counts)
    assert sum(visited) < 0.5 * len(vectors) * len(items)
    for item in range(len(items)):
        q = np.zeros(size, np.int64)
        q[block.terms[item]] = block.times[item]
        every = sorted((-int((q[t] * x).sum()), d) for d, t, x in vectors)
        every = [(-s, d) for s, d in every if s < 0][:5]
        scores, ids, _ = best.held.get(item, ([], [], []))
        assert sorted(zip(scores, ids, strict=True), key=lambda x: (-x[0], x[1])) == every
