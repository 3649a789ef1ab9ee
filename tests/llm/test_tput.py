"""TPUT against plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from spanloom.llm import tput

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    pooled = {}
    for item, text in items:
        pooled.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in pooled.items():
        scored = []
        for d, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(f * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, f in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, row int, item_id string, term string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in tput.rank(d, b, k).collect()), key=str)


def sample(seed, n_docs=400, n_items=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Äther", "ÄTHER", "7b"]
    weight = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weight, k=n))
    return [(i * 3 % 1009, text(rng.choice([1, 5, 20, 80]))) for i in range(n_docs)], [(i, text(rng.choice([1, 3, 12, 40]))) for i in range(n_items)]


@pytest.mark.parametrize(("seed", "head", "size"), [(1, 100, 1 << 20), (2, 10, 300), (3, 10, 50)])
def test_against_full_scoring(spark, monkeypatch, seed, head, size):
    """With few and with many slices, ranges and blocks of queries."""
    monkeypatch.setattr(tput, "HEAD", head)
    monkeypatch.setattr(tput, "SLICE_POSTINGS", size)
    monkeypatch.setattr(tput, "RANGE_POSTINGS", size)
    monkeypatch.setattr(tput, "BLOCK_TERMS", 20 if size < 1000 else 50_000)
    docs, items = sample(seed)
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("k", [1, 3])
def test_other_k_and_shallow_heads(spark, k):
    docs, items = sample(4, 150, 6)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    q = tput.query_terms(b)
    got = sorted((tuple(r) for r in tput.search(tput.build(d), q, k, head=1).collect()), key=str)
    assert got == brute(docs, items, k)


def test_nulls_ties_copies_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(tput, "SLICE_POSTINGS", 20)
    docs = [(5, "a b c"), (None, "a b c"), (3, "A-B_C"), (9, None), (2, ""), (4, "..."), (7, "a" * 100_000), (8, "É é a"), (3, "a b c")] + [(100 + i, "x y z") for i in range(60)] + [(200, "q " * 30_000)]
    items = [(1, "a b"), (2, ""), (3, None), (4, "none such"), (5, "x x x"), (6, "é É"), (7, "q"), (1, "c c")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 2) == brute(docs, items, 2)


def test_items_without_id_and_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a b"), (2, "c")], []) == []
    assert found(spark, [(1, "...")], [(1, "a")]) == []
    assert found(spark, [(1, "a")], [(None, "a"), (2, "a")]) == brute([(1, "a")], [(2, "a")])


def test_whole_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted((tuple(r) for r in tput.rank(docs, items).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
