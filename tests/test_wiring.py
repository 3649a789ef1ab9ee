"""Refusals: rankings, indexes, baselines, candidates and forms that do not fit; and runs side by side."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.operators import authoring, dense, evaluate, fusion, golden, lexical, relevance, retrieve
from spanloom.operators.ranking import RankingError, checked
from spanloom.plans.config import Chunking, Embedding, Retrieval
from spanloom.sources import stores

RANKED = "query_id string, chunk_id string, score double, rank int"


def test_duplicates_are_refused(spark):
    good = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 0.5, 2)], RANKED)
    twice = good.unionByName(good.limit(1))
    assert checked(good).count() == 2 and fusion.reciprocal_rank([good, good]).count() == 2
    with pytest.raises(RankingError, match="q / "):
        checked(twice)
    with pytest.raises(Exception, match="twice in one arm"):
        fusion.reciprocal_rank([good, twice]).collect()


def test_wiring(spark):
    chunks = spark.createDataFrame([("a", "d", 0, 5, "alpha"), ("b", "d", 5, 9, "beta")], "chunk_id string, doc_id string, char_start int, char_end int, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("x", [1.0])], "chunk_id string, vector array<double>")
    found = {(r["problem"], r["subject"]) for r in retrieve.wiring_problems(chunks, vectors=vectors, postings=lexical.postings_of(chunks.where("chunk_id = 'a'").withColumn("chunk_id", F.lit("y"))), dimension=2).collect()}
    assert found == {("unresolved-vector", "x"), ("missing-vector", "b"), ("duplicate-vector", "a"), ("wrong-dimension", "x"), ("unresolved-posting", "y")}
    assert {r["problem"] for r in retrieve.wiring_problems(chunks.limit(0)).collect()} == {"empty-corpus"}
    config = Retrieval(name="n", retrieval_mode="dense", top_k=2, dense_top_n=2, chunking=Chunking(chunk_size=64, chunk_overlap=0), embedding=Embedding(model_id="m", revision="r", dimension=2))
    sound = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, vector array<double>")
    retrieve.checked_wiring(config, chunks, sound)
    with pytest.raises(RankingError):
        retrieve.checked_wiring(config, chunks, vectors)
    with pytest.raises(RankingError):
        retrieve.checked_wiring(config, chunks, sound, lexical.build(chunks))
    queries = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    qv = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [r["chunk_id"] for r in retrieve.retrieve(config, queries, chunks, qv, sound).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="no chunk has the id"):
        retrieve.retrieve(config, queries, chunks.where("chunk_id = 'b'"), qv, sound).collect()


def test_stored_index_ranks_as_the_corpus_does(spark, tmp_path):
    rng = random.Random(6)
    chunks = spark.createDataFrame([(f"c{i:03d}", " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30)))) for i in range(120)], "chunk_id string, text string")
    terms = lexical.query_terms(spark.createDataFrame([("q1", "a b cc"), ("q2", "jj"), ("q3", "zzz")], "query_id string, query string"))
    lexical.write(lexical.build(chunks), str(tmp_path / "i"), parts=3)
    rows = lambda df: {(r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 9)) for r in df.collect()}
    for kw in ({}, {"k1": 0.5, "b": 0.0}):
        want = rows(lexical.search(chunks, terms, 10, **kw))
        assert want and want == rows(lexical.search_stored(lexical.read(spark, str(tmp_path / "i")), terms, 10, **kw)) == rows(lexical.search_stored(lexical.build(chunks), terms, 10, **kw))


def test_hash_counts(spark):
    rows = spark.createDataFrame([(1, "a a b"), (2, ""), (3, None)], "id long, text string")
    got = {r["id"]: list(r["vector"]) for r in dense.hash_counts(rows, "id", "text").collect()}
    assert sorted(got[1])[-2:] == [1, 2] and sum(got[1]) == 3 and got[2] == got[3] == [1] + [0] * 255


def test_runs_side_by_side_equal_runs_alone(spark):
    queries = spark.createDataFrame([("q1", "procedural", "llm"), ("q2", "multi-hop", "human"), ("q3", "multi-hop", "llm")], "query_id string, category string, origin string")
    labels = spark.createDataFrame([("q1", "d", 0, 100, 3), ("q2", "e", 0, 100, 2), ("q3", "e", 0, 100, 1)], "query_id string, doc_id string, char_start int, char_end int, gain int")
    kind = "config string, query_id string, chunk_id string, doc_id string, char_start int, char_end int, rank int"
    results = spark.createDataFrame([("x", "q1", "c1", "d", 0, 100, 2), ("x", "q1", "c0", "z", 0, 100, 1), ("y", "q2", "c2", "e", 0, 100, 1)], kind)
    both = {tuple(r) for r in evaluate.config_scores(results, labels, queries, ["x", "y"]).collect()}
    alone = {(c, *r) for c in "xy" for r in map(tuple, relevance.query_scores(results.where(f"config = '{c}'"), labels, queries).collect())}
    assert both == alone and len(both) == 2 * 2 * 4
    counts = evaluate.query_counts(labels, queries).first()
    assert (counts["n_queries"], counts["n_skipped"]) == (3, 1)
    report = {(r["config"], r["grp"], r["metric"], r["k"]): r["mean"] for r in evaluate.report(evaluate.config_scores(results, labels, queries, ["x", "y"])).collect()}
    assert report["x", "all", "mrr", 3] == 0.25 and report["y", "human", "recall", 1] == 1.0
    assert evaluate.intervals(evaluate.config_scores(results, labels, queries, ["x", "y"])).count() == 2 * 3 * 4


def test_pairs_inside(spark):
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    labels = spark.createDataFrame([("q1", 1), ("q1", 2), ("q2", 1), ("q2", None)], "query_id string, doc_id int")
    docs = spark.createDataFrame([(1,), (1,), (2,)], "doc_id int")
    assert [r["query_id"] for r in golden.pairs_inside(queries, labels, docs).collect()] == ["q1"]


def test_passages_follow_the_rule_and_too_few_are_an_error(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([2000, 100, 2003, 5000])], "doc_id int, text string")
    want, rng, turn = [], random.Random(3), 0
    long = [(0, 2000), (2, 2003), (3, 5000)]
    while len(want) < 9:
        doc, n = long[turn % 3]
        start = rng.randrange(0, n - 1500 + 1)
        if (doc, start) not in want:
            want.append((doc, start))
            turn += 1
    got = golden.sample_passages(docs, 9, 3).orderBy("passage_id").collect()
    assert [(r["doc_id"], r["char_start"]) for r in got] == want and {len(r["text"]) for r in got} == {1500}
    few = docs.where("doc_id = 0")
    assert golden.sample_passages(few, 2, 3, window=1999).count() == 2  # two places only
    with pytest.raises(ValueError):
        golden.sample_passages(few, 3, 3, window=1999)
    with pytest.raises(ValueError):
        golden.sample_passages(docs.where("doc_id = 1"), 1, 3)


def test_baselines_and_candidates(spark, tmp_path):
    runs = spark.createDataFrame([("a", "h1"), ("b", "h2")], "config_name string, config_hash string")
    stores.bless(runs, str(tmp_path / "b"), "better", "2024")
    assert {(r["config_name"], r["reason"]) for r in stores.read_baseline(spark, str(tmp_path / "b")).collect()} == {("a", "better"), ("b", "better")}
    runs.withColumn("reason", F.lit(" ")).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(stores.StoreError):
        stores.read_baseline(spark, str(tmp_path / "bad"))
    one = spark.createDataFrame([("c-0001", "q")], "candidate_id string, query string")
    stores.append_candidates(one, str(tmp_path / "c"))
    stores.append_candidates(one.withColumn("candidate_id", F.lit("c-0002")), str(tmp_path / "c"))
    with pytest.raises(stores.StoreError):
        stores.append_candidates(one, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2


DOC = "The court held that the motion was denied. A second sentence follows here."


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        (f"query: what\ncategory: procedural\nspans:\n- {{doc_id: d, gain: 3, quote: {json.dumps(DOC[4:40])}}}", None),
        ("a: [", "not-yaml"), ("just words", "no-mapping"), ("query: ' '", "no-query"), ("query: q\ncategory: x", "bad-category"), ("query: q\ncategory: procedural\nspans: none", "no-spans"),
        ("query: q\ncategory: procedural\nspans: [3]", "bad-span"), ("query: q\ncategory: procedural\nspans: [{doc_id: zz, gain: 3}]", "unknown-document"), ("query: q\ncategory: procedural\nspans: [{doc_id: d, gain: high}]", "bad-gain"),
        ("query: q\ncategory: procedural\nspans: [{doc_id: d, gain: 3, quote: short}]", "quote-too-short"), ("query: q\ncategory: procedural\nspans: [{doc_id: d, gain: 3, quote: nowhere to be found at all}]", "quote-not-found"),
        (f"query: q\ncategory: procedural\nspans: [{{doc_id: d, gain: 1, quote: {json.dumps(DOC[:30])}}}]", "no-relevant-label"),
    ],
)
def test_forms(spark, text, problem):
    forms = spark.createDataFrame([("f", text)], "form_id string, text string")
    got = authoring.resolve(authoring.parse(forms), spark.createDataFrame([("d", DOC, 100)], "doc_id string, text string, char_start int")).first()
    assert got["problem"] == problem
    assert problem or [tuple(x) for x in got["labels"]] == [("d", 104, 140, 3, DOC[4:40])]


def test_screen(spark):
    assert authoring.parse_form(authoring.template("d"))[0] == "no-query"
    row = spark.createDataFrame([("c-1", "why", "procedural", "d", 100, DOC, 0.5, 2, None, [(104, 109, 3, "court"), (106, 112, 2, "urt he"), (90, 104, 1, "x"), (115, 119, 2, "that")])], "candidate_id string, query string, category string, doc_id string, char_start int, text string, overlap double, longest_run int, warning string, labels array<struct<char_start:int,char_end:int,gain:int,quote:string>>")
    got = authoring.screen(row).first()["screen"]
    assert "The {3: court} held {2: that} the motion" in got and "query: why" in got and "  gain 2 at 115-119: that" in got


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["queries"]) == 0 and "bm25_top10" in capsys.readouterr().out
    assert cli.main(["template"]) == 0 and "spans:" in capsys.readouterr().out
    assert cli.main(["query", "is_html", "/root/testdata/sf0.001", "--rows", "2"], spark) == 0 and "page_id" in capsys.readouterr().out
    told = stores.write_snapshot(spark.createDataFrame([("a", "t", "", "", "", "")], stores.DOCUMENT), str(tmp_path / "s"), corpus_id="x", source="y")
    (tmp_path / "m.json").write_text(json.dumps(told))
    assert cli.main(["verify", str(tmp_path / "s"), str(tmp_path / "m.json")], spark) == 0
    spark.createDataFrame([("a", "u", "", "", "", "")], stores.DOCUMENT).write.mode("overwrite").json(str(tmp_path / "s"))
    assert cli.main(["verify", str(tmp_path / "s"), str(tmp_path / "m.json")], spark) == 1 and "a changed" in capsys.readouterr().out
