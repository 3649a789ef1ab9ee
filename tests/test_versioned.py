"""The keyed index: whole writes or none, versions that stay, two writers, vacuum."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import dense, retrieve
from spanloom.operators.ranking import RankingError
from spanloom.plans import fixtures
from spanloom.sources import versioned
from spanloom.sources.stores import StoreError


def rows(spark, key, n, parts=4):
    return spark.range(n).repartition(parts).select(F.lit(key).alias("index_key"), F.col("id").alias("chunk_id"), F.concat(F.lit(key), F.col("id").cast("string")).alias("text"))


def keys(spark, path, version=None):
    return {r["index_key"]: r["n"] for r in versioned.loaded_keys(spark, path, version).collect()}


def test_keys_are_replaced_and_versions_stay(spark, tmp_path):
    path = str(tmp_path / "index")
    assert versioned.current(path) == 0 and keys(spark, path) == {}
    versioned.load(rows(spark, "a", 30).unionByName(rows(spark, "b", 5)), path)
    old = versioned.read(spark, path, "a")
    versioned.load(rows(spark, "a", 7), path)
    assert versioned.current(path) == 2 and keys(spark, path) == {"a": 7, "b": 5} and keys(spark, path, 1) == {"a": 30, "b": 5}
    assert versioned.read(spark, path, "a").count() == 7 and old.count() == 30 and versioned.read(spark, path, "a", 1).count() == 30
    versioned.load(rows(spark, "a", 0), path)
    assert versioned.current(path) == 2
    for ask in (lambda: versioned.read(spark, path, "zzz"), lambda: keys(spark, path, 9)):
        with pytest.raises(StoreError):
            ask()


def files_in(path):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(path) for name in names)


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    versioned.load(rows(spark, "a", 30), path)
    before = files_in(path)
    late = rows(spark, "a", 40, 4).withColumn("text", F.when(F.col("chunk_id") == 37, F.raise_error(F.lit("lost half-way")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost half-way"):
        versioned.load(late, path)
    with pytest.raises(Exception, match="no index_key"):
        versioned.load(rows(spark, "a", 3).withColumn("index_key", F.lit(None).cast("string")), path)
    with pytest.raises(Exception, match="have an index_key"):
        versioned.load(spark.range(3), path)
    assert versioned.current(path) == 1 and keys(spark, path) == {"a": 30} and files_in(path) == before


def test_a_task_later_than_the_abort_leaves_no_file(tmp_path):
    path = str(tmp_path / "index")
    writer = versioned._Writer(path)
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([pa.RecordBatch.from_pydict({"index_key": ["a"], "text": ["t"]})]))
    assert files_in(path) == 0


def test_a_killed_write_is_not_read_and_is_vacuumed(spark, tmp_path):
    path = str(tmp_path / "index")
    versioned.load(rows(spark, "a", 30), path)
    versioned.load(rows(spark, "b", 3), path)
    versioned.load(rows(spark, "a", 8), path)
    left = tmp_path / "index" / "data" / "killed"
    left.mkdir()
    (left / "x.parquet").write_bytes(b"half a file")
    (tmp_path / "index" / "versions" / "v000000004.json.abc").write_text("{")
    assert keys(spark, path) == {"a": 8, "b": 3} and versioned.read(spark, path, "a").count() == 8
    gone = versioned.vacuum(path, 2)
    assert gone == 1 and keys(spark, path, 2) == {"a": 30, "b": 3}
    assert versioned.vacuum(path) > 0 and versioned.read(spark, path, "a").count() == 8 and versioned.read(spark, path, "b").count() == 3
    with pytest.raises(StoreError):
        keys(spark, path, 2)


def test_two_writers_that_follow_one_version(spark, tmp_path, monkeypatch):
    """The second finds its version taken and puts its keys over the first one's."""
    path = str(tmp_path / "index")
    one, two = versioned._Writer(path), versioned._Writer(path)
    message = lambda w, key: [w.write(iter(rows(spark, key, 4).toArrow().to_batches()))]
    a, b = message(one, "a"), message(two, "b")
    real, raced = versioned._make, []

    def race(fs, name, data):
        if not raced:
            raced.append(name)
            one.commit(a)
        return real(fs, name, data)

    monkeypatch.setattr(versioned, "_make", race)
    two.commit(b)
    assert versioned.current(path) == 2 and keys(spark, path) == {"a": 4, "b": 4}


def test_an_index_of_a_configuration(spark, tmp_path):
    config, path = fixtures.configuration("dense"), str(tmp_path / "index")
    chunks = spark.createDataFrame([(f"c{i}", i, 0, 9, f"word{i} word{i % 3} text") for i in range(9)], "chunk_id string, doc_id long, char_start int, char_end int, text string")
    vectors = dense.hash_counts(chunks, "chunk_id", "text")
    with pytest.raises(RankingError, match="missing-vector"):
        retrieve.store(config, chunks, vectors.where("chunk_id <> 'c3'"), path)
    with pytest.raises(RankingError, match="empty-corpus"):
        retrieve.store(config, chunks.limit(0), vectors.limit(0), path)
    assert versioned.current(path) == 0
    key = retrieve.store(config, chunks, vectors, path)
    assert key == retrieve.index_key(fixtures.configuration("hybrid", 0.1)) != retrieve.index_key(fixtures.configuration("dense", chunking=fixtures.Chunking()))
    q = dense.hash_embed(spark.createDataFrame([("q", "word4")], "query_id string, query string"), "query_id", "query")
    assert retrieve.search_by_key(path, key, q, 1).first()["chunk_id"] == "c4"
    got = retrieve.retrieve_stored(config, spark.createDataFrame([("q", "word4")], "query_id string, query string"), q, path)
    assert [r["chunk_id"] for r in got.where("rank = 1").collect()] == ["c4"] and got.count() == 9
