"""Files round-trip, and wrong ones are refused."""

import hashlib
import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.sources import digests, stores
from spanloom.streaming import review_log

DOCS = [("b", "text é   \"q\"", "t", "c", "1990", ""), ("a", "other\nline", "", "", "", "u")]


def test_snapshot(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, stores.DOCUMENT)
    m = stores.write_snapshot(docs, str(tmp_path / "s"), corpus_id="x", source="y")
    assert stores.verify_snapshot(spark, str(tmp_path / "s"), m).count() == 2
    with pytest.raises(stores.StoreError):
        stores.verify_snapshot(spark, str(tmp_path / "s"), m | {"doc_count": 3})
    changed = spark.createDataFrame([DOCS[0], ("a", "another", "", "", "", "u"), ("c", "new", "", "", "", "")], stores.DOCUMENT)
    changed.select(*stores.DOCUMENT_COLUMNS).write.mode("overwrite").json(str(tmp_path / "s"))
    with pytest.raises(stores.StoreError, match="a changed .*; c added"):
        stores.verify_snapshot(spark, str(tmp_path / "s"), m)
    lines = stores.line_manifest(docs, corpus_id="x", source="y")
    assert stores.verify_snapshot(spark, stores_path(spark, docs, tmp_path), lines).count() == 2
    assert stores.manifest_hash(m).startswith("sha256:")


def stores_path(spark, docs, tmp_path):
    stores.write_snapshot(docs, str(tmp_path / "t"), corpus_id="x", source="y")
    return str(tmp_path / "t")


def test_digest_tree(spark):
    """Any order and partitions give one root; each kind of fault is named; trees of one row, of none, with nulls and repeats."""
    row = lambda i, t: (None if i is None else str(i), t)
    rows = [row(i, f"text {i}") for i in range(300)] + [row(None, "x"), row(7, "text 7"), row(5, "other text of 5")]
    frame = lambda r: spark.createDataFrame(r, "doc_id string, text string")
    tree = lambda r, bits=8: digests.tree(frame(r), ["doc_id", "text"], bits)
    one, again = tree(rows), digests.tree(frame(rows[::-1]).repartition(5), ["doc_id", "text"], 8)
    assert one.root == again.root and one.docs == 303 and digests.faults(one, again).count() == 0
    now = [r for r in rows if r[0] != "3"] + [row("new", "y"), row(8, "text 8")]
    now = [("4", "changed") if r[0] == "4" else r for r in now]
    found = {(r["doc_id"], r["problem"]) for r in digests.faults(one, tree(now)).collect()}
    assert found == {("3", "missing"), ("4", "changed"), ("new", "added"), ("8", "repeated")}
    plain = {}
    for doc, text in rows:
        digest = hashlib.sha256("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in (doc, text)).encode()).hexdigest()
        plain.setdefault(int(hashlib.sha256((doc or "").encode()).hexdigest()[:2], 16), Counter())[(digest, doc or "")] += 1
    level = {k: hashlib.sha256(",".join(f"{d}*{n}" for (d, _), n in sorted(c.items())).encode()).hexdigest() for k, c in plain.items()}
    for _ in range(2):
        above = {}
        for k in sorted(level):
            above.setdefault(k >> 4, []).append(f"{k}*{level[k]}")
        level = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in above.items()}
    assert one.root == level[0]
    assert tree([]).root == digests.EMPTY and tree(rows[:1], 0).docs == 1 and digests.faults(tree([]), tree(rows[:1])).first()["problem"] == "added"
    assert digests.bits_for(1024) == 0 and digests.bits_for(1025) == 4 and digests.bits_for(10**12) == 28
    with pytest.raises(ValueError):
        tree(rows, 5)


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"doc_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        stores.read_snapshot(spark, str(tmp_path / "x.json")).collect()


def test_embeddings_and_scores(spark, tmp_path):
    rows = spark.createDataFrame([("k1", [1.0, 2.0]), ("k2", [3.0, 4.0])], "key string, embedding array<double>")
    stores.write_embeddings(rows, str(tmp_path / "e"))
    assert {r["key"] for r in stores.read_embeddings(spark, str(tmp_path / "e")).collect()} == {"k1", "k2"}
    with pytest.raises(stores.StoreError):
        stores.write_embeddings(rows.union(rows), str(tmp_path / "e2"))
    scores = spark.createDataFrame([("q", 5.0, "p1", 0.5), ("q", 5.0, "p2", 0.25)], "query_key string, compute_ms double, passage_key string, score double")
    stores.write_scores(scores, str(tmp_path / "r"))
    assert {tuple(r) for r in stores.read_scores(spark, str(tmp_path / "r")).collect()} == {tuple(r) for r in scores.collect()}


def run(name, value):
    s = {"mean": value, "ci_low": value, "ci_high": value, "n": 9}
    return {"config_name": name, "config_hash": "h" + name, "golden_set_hash": "g", "corpus_manifest_hash": "c", "code_version": "1", "run_fingerprint": "f", "n_queries": 9, "n_skipped": 0, "overall": {"recall": {"10": s}}, "by_category": {"x": {"recall": {"10": s}}}, "by_origin": {}, "latency": {"total_ms": 1.5}}


def test_runs_and_baseline(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    for n in "ab":
        (tmp_path / "runs" / f"{n}.json").write_text(json.dumps(run(n, 0.5), indent=2, sort_keys=True))
    runs = stores.read_runs(spark, str(tmp_path / "runs"))
    assert {(r["config"], r["metric"], r["k"], r["mean"]) for r in stores.run_metrics(runs).collect()} == {("a", "recall", 10, 0.5), ("b", "recall", 10, 0.5)}
    with pytest.raises(stores.StoreError):
        stores.bless(runs, str(tmp_path / "base"), "  ", "now")
    with pytest.raises(stores.StoreError):
        stores.bless(runs.union(runs), str(tmp_path / "base"), "why", "now")
    stores.bless(runs, str(tmp_path / "base"), "why", "now")
    stores.write_runs(runs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_index_is_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "idx")
    assert stores.loaded_keys(spark, path).count() == 0
    row = lambda k, n: spark.range(n).select(F.lit(k).alias("index_key"), F.col("id").alias("chunk_id"))
    stores.load_index(row("a", 3), path)
    stores.load_index(row("b", 2), path)
    stores.load_index(row("a", 1), path)
    assert {tuple(r) for r in stores.loaded_keys(spark, path).collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(stores.StoreError):
        stores.read_index(spark, path, "zzz")


def test_review_log_stream(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "seq long, subject string, action string"
    stores.append_decisions(spark.createDataFrame([(2, "a", "accept"), (1, "b", "skip")], schema), path)
    q = review_log.latest_decisions(review_log.read_log(spark, path, schema)).writeStream.outputMode("complete").format("memory").queryName(f"latest{time.time_ns()}").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        stores.append_decisions(spark.createDataFrame([(1, "a", "reject"), (3, "b", "reject")], schema), path)
        q.processAllAvailable()
        assert {(r["subject"], r["action"]) for r in spark.table(q.name).collect()} == {("a", "accept"), ("b", "reject")}
    finally:
        q.stop()


def test_golden_hash_ignores_the_clock():
    pair = {"query_id": "q", "query": "x", "category": "c", "labels": [], "provenance": {"origin": "human", "reviewed_at": "1", "review_seconds": 2}}
    other = pair | {"provenance": {"origin": "human", "reviewed_at": "9", "review_seconds": 7}}
    assert stores.golden_set_hash([pair]) == stores.golden_set_hash([other])
