"""What must not grow faster than its input: work for each vector, rows that searches shuffle, windows of long texts."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.operators import aggregate, chunking, dense, golden, lexical
from spanloom.operators.ranking import Best
from spanloom.plans import fixtures
from spanloom.plans.config import Chunking


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unit_works_out_a_norm_once(spark):
    long = spark.range(0, 8, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i + F.col("id")).alias("v"))
    began = time.monotonic()
    assert [round(r[0], 9) for r in long.select(dense.norm(dense.unit(F.col("v")))).collect()] == [1.0] * 8
    assert time.monotonic() - began < 15  # 400 million steps a vector, were it worked out for each number


def test_stored_bm25_shuffles_no_candidates(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", f"ab{i % 7} Cd{i % 3}, cd{i % 3}!" if i % 5 else " ?") for i in range(60)], "chunk_id string, text string")
    terms = lexical.query_terms(spark.createDataFrame([("p", "ab1 cd2 zz"), ("q", "cd1"), ("r", "zz")], "query_id string, query string"))
    index = lexical.build(chunks)
    found = lexical.score_stored(index, terms)
    assert "Exchange" not in plan_of(found)
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    for b in (0.75, 0.0):
        want = rows(lexical.search(chunks, terms, 4, b=b))
        assert len(want) == 8 and want == rows(lexical.search_stored(index, terms, 4, b=b))
    assert sorted((r["query_id"], r["chunk_id"]) for r in found.collect()) == sorted((r["query_id"], r["chunk_id"]) for r in lexical.score(chunks, terms).collect())
    assert lexical.search_stored(index, terms.where("query_id = 'r'"), 4).count() == 0


def test_a_task_passes_on_its_best_alone():
    rng = np.random.default_rng(3)
    ids, score = [f"c{i:04d}" for i in rng.permutation(2000)], np.round(rng.random((2000, 3)), 2)
    best = Best(["x", "y", "z"], 5)
    for first in range(0, 2000, 170):
        best.add(pa.array(ids[first : first + 170]), score[first : first + 170], score[first : first + 170] > 0.0)
    got = sorted((r["query_id"], r["chunk_id"]) for b in best.rows() for r in b.to_pylist())
    assert got == sorted((q, c) for j, q in enumerate("xyz") for _, c in sorted((-score[i, j], ids[i]) for i in range(2000))[:5])


def test_pairs_of_vectors_are_products_of_blocks(spark, monkeypatch):
    """No row is made for a pair; cells of a few rows give what all pairs give: ties, ids that are missing, a query's own id."""
    monkeypatch.setattr(dense, "BLOCK_ROWS", 50), monkeypatch.setattr(dense, "QUERY_ROWS", 7), monkeypatch.setattr(dense, "CELLS", 60)
    rng = np.random.default_rng(5)
    own = rng.integers(-3, 4, (300, 4)).astype(float) + [0.5, 0, 0, 0]
    own[100:200] = own[7]
    rows = [(None if i == 150 else i, own[i].tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    q = spark.createDataFrame([rows[i] for i in (*range(0, 300, 11), 150)], "query_id long, vector array<float>")
    for skip_same in (False, True):
        want = set()
        for query_id, x in (tuple(r) for r in q.collect()):
            score = {c: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) for c, y in rows if not skip_same or None not in (c, query_id) and c != query_id}
            best = sorted(score, key=lambda c: (-round(score[c], 9), -1 if c is None else c))[:20]
            want |= {(query_id, c, round(score[c], 6), k) for k, c in enumerate(best, 1)}
        found = dense.search(q, v, 20, skip_same)
        assert "NestedLoopJoin" not in plan_of(found) and "CartesianProduct" not in plan_of(found)
        assert {(r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in found.collect()} == want
    assert dense.search(q.limit(0), v, 20).count() == 0 == dense.search(q, v.limit(0), 20).count()


@pytest.mark.parametrize("name", ["dense_self_excluded", "dense_top50"])
def test_dense_queries_make_no_row_for_a_pair(spark, sf, name):
    found = entry.queries()[name](spark, sf)
    assert "NestedLoopJoin" not in plan_of(found) and "CartesianProduct" not in plan_of(found)
    own = found.where("query_id = chunk_id").count()
    assert own == (0 if name == "dense_self_excluded" else found.select("query_id").distinct().count())


@pytest.mark.parametrize("vector,error", [(None, "no direction"), ([], "no direction"), ([1.0, None], "no direction"), ([0.0, 0.0], "no direction"), ([1.0, float("inf")], "no direction"), ([1.0, float("nan")], "no direction"), ([1.0, 2.0, 3.0], "differ in length")])
def test_vectors_that_cannot_be_compared(spark, vector, error):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, vector)], "chunk_id long, vector array<double>")
    q = v.where("chunk_id = 1").withColumnRenamed("chunk_id", "query_id")
    with pytest.raises(Exception, match=error):
        dense.search(q, v, 1).collect()


def test_a_task_rounds_and_orders_as_the_plan_does():
    """A half goes away from zero, so 1 / 1024 ties with the number above it; a missing id comes first."""
    best = Best(["x"], 1)
    best.add(pa.array([1, 2, None, 3]), np.array([[1 / 1024], [0.0009765634], [0.0], [-1 / 1024]]))
    assert [b.to_pylist() for b in best.rows()] == [[{"query_id": "x", "chunk_id": 1, "score": 1 / 1024}]]
    best = Best(["x"], 1)
    best.add(pa.array([4, None, 2]), np.array([[0.5], [0.5], [0.5]]))
    assert [b.to_pylist() for b in best.rows()] == [[{"query_id": "x", "chunk_id": None, "score": 0.5}]]


def test_vectors_beside_their_texts(spark):
    rows = spark.createDataFrame([(1, "b B a"), (2, ""), (3, None), (4, "?!"), (5, "É_é x1")], "chunk_id long, text string")
    got = {r["chunk_id"]: list(r["vector"]) for r in dense.with_hash_counts(rows).collect()}
    assert got == {r["chunk_id"]: list(r["vector"]) for r in dense.hash_counts(rows, "chunk_id", "text").collect()}
    assert sum(got[1]) == 3 and got[2] == got[3] == got[4] == [1] + [0] * 255


def test_draws_are_joined_in_many_tasks(spark):
    scores = spark.createDataFrame([(f"q{i}", "m", 1, i / 40) for i in range(40)], "query_id string, metric string, k int, value double")
    assert "REPARTITION_BY_NUM" in plan_of(aggregate.bootstrap(scores, resamples=50))


@pytest.mark.parametrize("size,overlap", [(64, 0), (64, 16), (65, 32)])
def test_windows_against_brute_force(spark, size, overlap):
    words = lambda n: "".join(f"w{i}{' .-'[i % 3]} " for i in range(n))
    texts = [None, "", " ?", "a", "  a", *["…" + words(n) for n in (1, 63, 64, 65, 66, 80, 98, 112, 113, 128, 129, 400)], "Ünï_cödé 💡 ９ x" * 5]
    want = set()
    for d, text in enumerate(texts):
        spans = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
        start = 0
        while spans:
            part = spans[start : start + size]
            want.add((d, start, start + len(part), part[0][0], part[-1][1], text[part[0][0] : part[-1][1]]))
            if start + size >= len(spans):
                break
            start += size - overlap
    got = chunking.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Chunking(chunk_size=size, chunk_overlap=overlap))
    assert {tuple(r) for r in got.drop("chunk_id").collect()} == want


def test_queries_alike_are_named_as_they_stand(spark):
    queries = spark.createDataFrame([("q-1", "die straße"), ("q-1-b", "DIE  STRASSE"), ("q-2", "weg")], "query_id string, query string")
    labels = spark.createDataFrame([("q-1", 1, 0, 5, 3), ("q-1-b", 1, 0, 5, 3), ("q-2", 1, 0, 5, 3)], "query_id string, doc_id long, char_start int, char_end int, gain int")
    assert [tuple(r) for r in golden.set_problems(queries, labels).collect()] == [("duplicate-query", "die straße", 2)]


def test_words_of_gold_documents_are_hashed_once(monkeypatch):
    """A document's runs come from one hash of each distinct word, not from lists of words made for each place."""
    hashed = []
    monkeypatch.setattr(fixtures.pd.util, "hash_array", lambda a, f=fixtures.pd.util.hash_array, **k: hashed.append(len(a)) or f(a, **k))
    rows = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, None]), pa.array(["a b c d " * 5000, None, "a b", "b c d a b"])], names=["doc_id", "text"])
    got = [r for b in fixtures._document_runs([2, 5])(iter([rows])) for r in b.to_pylist()]
    assert hashed == [5]  # four words and the empty one at an end
    assert {i: sum(r["doc_id"] == i for r in got) for i in (7, 8, 9, None)} == {7: 20_000 + 19_997, 8: 0, 9: 1, None: 4 + 1}
    assert {r["anchor"] for r in got if r["doc_id"] is None} <= {r["anchor"] for r in got if r["doc_id"] == 7}


def test_gold_documents_against_brute_force(spark):
    passages = ["one", "two  words", "three words here", "x a b\tc d e f y", " lead a b c", "a b c d e f g tail ", "", None, "nowhere to be found at all", "ünï 💡 ９ çode ß"]
    texts = [None, "", "one", "prefixone two  wordsuffix", "zx a b\tc d e f yz", "no lead a b c\n", "q a b c d e f g tail  a b c d e f g tail ", "three  words here", "three words hereafter", "aünï 💡 ９ çode ßb"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "one three words here")], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    got = {(r["item_id"], r["doc_id"], r["at"]) for r in fixtures.gold_documents(docs.where("doc_id is not null"), benchmark).collect()}
    assert got == {(i, d, t.find(p) + 1) for i, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and p in t and len(p.split())} | {(6, d, 1) for d, t in enumerate(texts) if t is not None}
