"""Known answers and contracts of the retrieval engine."""

import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import identity
from spanloom.functions import text as T
from spanloom.operators import aggregate, caches, chunking, dense, fusion, gate, golden, lexical, relevance, retrieve
from spanloom.operators.ranking import top_n
from spanloom.plans import fixtures
from spanloom.plans.config import Chunking, ConfigError, Embedding, Fusion, Lexical, Reranker, Retrieval

TINY = [("d1", "the court granted summary judgment"), ("d2", "the court denied the motion"), ("d3", "summary judgment standard")]


def bm25(spark, chunks, query, **kw):
    q = spark.createDataFrame([("q", query)], "query_id string, query string")
    rows = lexical.search(spark.createDataFrame(chunks, "chunk_id string, text string"), lexical.query_terms(q), 10, **kw)
    return [(r["chunk_id"], r["score"]) for r in rows.orderBy("rank").collect()]


def test_bm25_known_scores(spark):
    got = bm25(spark, TINY, "summary judgment")
    assert [c for c, _ in got] == ["d3", "d1"]
    assert got[0][1] == pytest.approx(1.0753683, rel=1e-6) and got[1][1] == pytest.approx(0.8843489, rel=1e-6)
    assert bm25(spark, TINY, "summary judgment judgment") == got


def test_bm25_ties_and_empty_chunks(spark):
    assert [c for c, _ in bm25(spark, [("zulu", "judgment"), ("alpha", "judgment"), ("mike", "judgment")], "judgment")] == ["alpha", "mike", "zulu"]
    assert [c for c, _ in bm25(spark, [("a", "---"), ("b", "judgment")], "judgment")] == ["b"]
    assert bm25(spark, [("a", "---")], "judgment") == []


def arm(spark, ids):
    return spark.createDataFrame([("q", c, 1.0 / (i + 1), i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, score double, rank int")


def test_rrf(spark):
    rows = top_n(fusion.reciprocal_rank([arm(spark, "abc"), arm(spark, "cad")]), 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "c", "b", "d"]
    assert [r["score"] for r in rows] == pytest.approx([1 / 61 + 1 / 62, 1 / 63 + 1 / 61, 1 / 62, 1 / 63])
    with pytest.raises(ValueError):
        fusion.reciprocal_rank([], 60)


def test_rerank_drops_the_rest_and_refuses_gaps(spark):
    scores = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.9)], "query_id string, chunk_id string, score double")
    assert [r["chunk_id"] for r in fusion.rerank(arm(spark, "abc"), scores, 2, 2).orderBy("rank").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="no rerank score"):
        fusion.rerank(arm(spark, "abc"), scores, 3, 2).collect()


def test_dense_refuses_zero_vectors_and_matches_arrow(spark):
    rng = random.Random(1)
    rows = [(f"c{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)]
    v = spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    q = v.limit(3).withColumnRenamed("chunk_id", "query_id")
    a, b = (sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in f(q, v, 5).collect()) for f in (dense.search, dense.search_arrow))
    assert a == b
    with pytest.raises(Exception, match="no direction"):
        dense.search(q, v.withColumn("vector", F.transform("vector", lambda x: x * 0)), 5).collect()


@pytest.mark.parametrize("chunk,span,want", [((100, 300), (0, 200), True), ((101, 300), (0, 200), False), ((0, 40), (0, 40), False)])
def test_cover_boundary(spark, chunk, span, want):
    r = spark.createDataFrame([("q", "c", "d", *chunk, 1)], "query_id string, chunk_id string, doc_id string, char_start int, char_end int, rank int")
    x = spark.createDataFrame([("q", "d", *span, 3)], "query_id string, doc_id string, char_start int, char_end int, gain int")
    assert (relevance.covers(r, x).count() == 1) is want


def metrics(spark, passages, spans, k):
    r = spark.createDataFrame([("q", f"c{i}", "d", a, b, i + 1) for i, (a, b) in enumerate(passages)], "query_id string, chunk_id string, doc_id string, char_start int, char_end int, rank int")
    x = spark.createDataFrame([("q", "d", a, b, g) for a, b, g in spans], "query_id string, doc_id string, char_start int, char_end int, gain int")
    q = spark.createDataFrame([("q", "multi-hop", "human")], "query_id string, category string, origin string")
    rows = relevance.query_scores(r, x, q, (k,)).collect()
    return (rows[0]["recall"], rows[0]["mrr"], rows[0]["ndcg"]) if rows else None


def test_metrics_known_answers(spark):
    two = [(0, 200, 2), (1000, 1200, 3)]
    assert metrics(spark, [(0, 200), (1000, 1200)], two, 10)[2] == pytest.approx((3 + 7 / math.log2(3)) / (7 + 3 / math.log2(3)))
    assert metrics(spark, [(0, 350)], [(0, 200, 2), (150, 350, 3)], 10)[2] == pytest.approx(7 / (7 + 3 / math.log2(3)))
    assert metrics(spark, [(5000, 5200), (6000, 6200), (0, 200)], two, 10)[:2] == pytest.approx((0.5, 1 / 3))
    assert metrics(spark, [(5000, 5200), (6000, 6200), (0, 200)], two, 1)[:2] == (0.0, 0.0)
    assert metrics(spark, [(0, 200)], [(0, 200, 1)], 10) is None
    assert metrics(spark, [], two, 10) == (0.0, 0.0, 0.0)


def test_bootstrap_is_the_seeded_percentile(spark):
    values = [random.Random(5).random() for _ in range(30)]
    rows = spark.createDataFrame([(f"q{i:02d}", "recall", 1, v) for i, v in enumerate(values)], "query_id string, metric string, k int, value double")
    got = aggregate.bootstrap(rows).first()
    rng = random.Random(20240101)
    means = sorted(statistics.fmean(values[rng.randrange(30)] for _ in range(30)) for _ in range(1000))
    assert (got["ci_low"], got["ci_high"]) == pytest.approx((means[25], means[975]))
    one = aggregate.bootstrap(rows.limit(1)).first()
    assert one["ci_low"] == one["ci_high"] == one["mean"]


def test_gate_limit_is_inclusive(spark):
    base = fixtures.run_rows(spark)
    at = fixtures.run_rows(spark, {"dense_512.recall": -0.010})
    over = fixtures.run_rows(spark, {"dense_512.recall": -0.0101})
    same = fixtures.run_identity(spark)
    status = lambda now: {r["config"]: r["status"] for r in gate.evaluate(fixtures.POLICY, base, now, same, same).collect()}
    assert status(at)["dense_512"] == "passed" and status(over)["dense_512"] == "failed"
    assert [r["config"] for r in gate.evaluate(fixtures.POLICY, base, at, same, same).collect()] == list(fixtures.POLICY.gated_configs)


def test_rerank_run_fails_against_hybrid(spark):
    rows = fixtures.run_rows(spark)
    as_now = rows.where("config = 'hybrid_512_rerank'").withColumn("config", F.lit("hybrid_512"))
    got = {r["metric"]: r["outcome"] for r in gate.regressions(gate.policy_rows(rows, fixtures.POLICY).where("config = 'hybrid_512'"), rows, as_now).collect()}
    assert got == {"recall": "ok", "mrr": "regression", "ndcg": "regression"}


TRICKY = ["İstanbul ΟΔΟΣ", "ﬃ Ⅷ ½ x² doc_id", "éclair", "नमस्ते दुनिया", "😀ok 中文字", "a‍b", "ªº ①", "٣٤", "ǅ ß", "‿a⁀b"]


def test_tokens_are_runs_of_letters_and_digits(spark):
    import regex

    rows = spark.createDataFrame(list(enumerate(TRICKY)), "i int, t string").select("i", T.tokens(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: regex.findall(r"[\p{L}\p{N}]+", t.lower()) for i, t in enumerate(TRICKY)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1é_ .\n", max_size=900), min_size=1, max_size=6))
def test_chunks_are_exact_spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = chunking.chunks(docs, Chunking(chunk_size=64, chunk_overlap=8)).persist()
    assert chunking.violations(rows, docs).count() == 0
    import regex

    for i, t in enumerate(texts):
        n = len(regex.findall(r"[\p{L}\p{N}]+", t))
        mine = sorted((r["token_start"], r["token_end"]) for r in rows.where(F.col("doc_id") == i).collect())
        starts = [] if not n else [0] if n <= 64 else list(range(0, math.ceil((n - 64) / 56) * 56 + 1, 56))
        assert mine == [(s, min(s + 64, n)) for s in starts]
    rows.unpersist()


def test_html_and_normalisation(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    markup = "<p>a &amp;lt;b&gt;</p><script>var t='</p>';</script><!-- c --><div>d</div>"
    assert one(T.normalise(T.html_to_text(F.lit(markup), built_in=False))) == "a &lt;b>\n\nd"
    assert one(T.normalise(F.lit("ﬁ [*12]x\r\n  *7 \r\n\n\n\ny  z \x1c"))) == "fi x\n\ny z"
    assert one(T.fold_query(F.lit("  Straße \n A "))) == "strasse a"
    assert one(T.looks_like_html(F.lit("1 < 2 and p > 3"))) is False


def dense_config(**kw):
    base = {"name": "a", "retrieval_mode": "dense", "top_k": 10, "dense_top_n": 50, "chunking": Chunking(tokenizer_id="BAAI/bge-small-en-v1.5"), "embedding": Embedding("BAAI/bge-small-en-v1.5", "5c38ec7c405ec4b44b94cc5a9bb96e735b38267a", 384, True, "Represent this sentence for searching relevant passages: ")}
    return Retrieval(**base | kw)


def test_config_identity_and_rules():
    assert dense_config().config_hash == dense_config(name="b", description="other").config_hash
    assert dense_config().config_hash == "e625eca8670b32ae"
    hybrid = {"retrieval_mode": "hybrid", "lexical": Lexical("bm25", 50), "fusion": Fusion()}
    assert dense_config(**hybrid).config_hash == "12d69d044a26196e"
    for bad in ({"dense_top_n": 5}, {"lexical": Lexical("bm25", 5)}, {"retrieval_mode": "hybrid"}):
        with pytest.raises(ConfigError):
            dense_config(**bad)
    with pytest.raises(ConfigError):
        Reranker(enabled=True)


def test_published_identities():
    manifest = {"content_sha256": "89139a646b6ed236faef811ac326edb9fe7b298a8782e3a12d4e35ff13db5660", "corpus_id": "courtlistener-scotus-1990-01-01..2020-12-31-n150", "doc_count": 150, "normalizer_version": "1", "retrieved_at": "", "source": "courtlistener-v4"}
    corpus = identity.sha256_identity(manifest)
    assert corpus == "sha256:606283c740d8d7b7b3fafb81eee7cb6c40236e5b63776540855451c41db48eb1"
    golden_hash = "sha256:879b242be5ce21fece48c8285cf2ecaa442aec53b181295988582f0f9b2d12b2"
    assert identity.run_fingerprint("e625eca8670b32ae", golden_hash, corpus, "0.1.0") == "9f8797917ff3b516effbc059377c666e"


def test_quotes_in_order_of_checks(spark):
    text = "x" * 30 + "y" + "the holding of the court is narrow" + "z"
    rows = spark.createDataFrame([(i, text, 100, q) for i, q in enumerate(["short", "q" * 601, "x" * 20, "the holding of the court", "not in there, whatever it is"])], "i int, text string, char_start int, quote string")
    got = {r["i"]: (r["code"], r["quote_start"]) for r in golden.resolve_quotes(rows).collect()}
    assert got == {0: ("quote-too-short", None), 1: ("quote-too-long", None), 2: ("quote-ambiguous", None), 3: (None, 131), 4: ("quote-not-found", None)}


def test_review_log_last_wins_and_skips_return(spark):
    log = spark.createDataFrame([(1, "a", "accept"), (3, "a", "reject"), (2, "a", "accept"), (4, "b", "skip")], "seq long, subject string, action string")
    assert {r["subject"]: r["action"] for r in golden.latest(log).collect()} == {"a": "reject", "b": "skip"}
    people = spark.createDataFrame([("a",), ("b",), ("c",)], "subject string")
    assert {r[0] for r in golden.pending(people, log).collect()} == {"b", "c"}
    assert {r[0] for r in golden.pending(people, log, skip_returns=False).collect()} == {"c"}
    assert golden.materialise_set(log).count() == 0


def test_echo_run(spark):
    rows = spark.createDataFrame([("a b c", "x a b y a b c z"), ("", "a"), ("a a", "a b a")], "query string, text string")
    assert {r["query"]: (r["overlap"], r["longest_run"]) for r in golden.echo(rows).collect()} == {"a b c": (1.0, 3), "": (0.0, 0), "a a": (1.0, 1)}


def test_caches(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    store = spark.createDataFrame([("a", 1)], "key string, v int")
    with pytest.raises(caches.MissingKeysError):
        caches.cached_only(asked, store)
    whole, report = caches.fill(asked, store, lambda todo: todo.select("key", F.lit(2).alias("v")))
    assert {tuple(r) for r in whole.collect()} == {("a", 1), ("b", 2)}
    assert report.first().asDict() == {"total": 3, "unique": 2, "reused": 1, "computed": 1}


def test_retrieve_end_to_end(spark):
    docs = spark.createDataFrame([("d1", "the tenant paid rent late every month " * 20), ("d2", "a patent claims a novel engine valve " * 20), ("d3", "the defendant waived the right to counsel " * 20)], "doc_id string, text string")
    chunks = chunking.chunks(docs, Chunking(chunk_size=64, chunk_overlap=8)).persist()
    queries = spark.createDataFrame([("q1", "late rent of a tenant"), ("q2", "engine valve patent")], "query_id string, query string")
    config = Retrieval("mini", "hybrid", 3, 20, Chunking(chunk_size=64, chunk_overlap=8), Embedding("hash", "1", 256), lexical=Lexical("bm25", 20), fusion=Fusion())
    out = retrieve.retrieve(config, queries, chunks, dense.hash_embed(queries, "query_id", "query"), dense.hash_embed(chunks, "chunk_id", "text")).collect()
    assert {(r["query_id"], r["doc_id"]) for r in out if r["rank"] == 1} == {("q1", "d1"), ("q2", "d2")}
    with pytest.raises(Exception, match="blank"):
        retrieve.retrieve(config, queries.withColumn("query", F.lit(" ")), chunks, dense.hash_embed(queries, "query_id", "query"), dense.hash_embed(chunks, "chunk_id", "text")).collect()
