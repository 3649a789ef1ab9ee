"""Files: corpus snapshots, embedding and rerank stores, golden sets, runs, baselines and replace-by-key indexes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.identity import sha256_identity
from spanloom.sources import digests

DOCUMENT = "doc_id string, text string, title string, court string, date_filed string, source_url string"
LABEL = "struct<doc_id:string,char_start:int,char_end:int,gain:int,quote:string>"
PAIR = f"query_id string, query string, category string, labels array<{LABEL}>, provenance struct<origin:string,generator_model:string,prompt_version:string,source_candidate_id:string,reviewer:string,reviewed_at:string,review_action:string,edited_fields:array<string>,review_seconds:double>"
DECISION = f"seq long, candidate_id string, action string, reviewer string, decided_at string, review_seconds double, reason string, pair struct<{PAIR.replace(' struct', ':struct').replace(' array', ':array').replace(' string', ':string')}>"
SUMMARY = "struct<mean:double,ci_low:double,ci_high:double,n:bigint>"
TABLE = f"map<string,map<string,{SUMMARY}>>"
RUN = f"config_name string, config_hash string, golden_set_hash string, corpus_manifest_hash string, code_version string, run_fingerprint string, n_queries long, n_skipped long, overall {TABLE}, by_category map<string,{TABLE}>, by_origin map<string,{TABLE}>, latency map<string,double>"
NORMALIZER_VERSION = "1"
DOCUMENT_COLUMNS = sorted(["doc_id", "text", "title", "court", "date_filed", "source_url"])


class StoreError(ValueError):
    """A file that is not what its description says."""


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one JSON object a line; a line that does not fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


# ---------------------------------------------------------------- corpus snapshots


def write_snapshot(docs: DataFrame, path: str, *, corpus_id: str, source: str, retrieved_at: str = "", codec: str = "gzip") -> dict[str, Any]:
    """Documents in order of doc_id as compressed JSON lines (zstd where Hadoop has it); returns their manifest.

    Its hash is the root of a digest tree, which is kept in ``path``.digest and says later which documents differ.
    """
    docs.select(F.to_json(F.struct(*DOCUMENT_COLUMNS)).alias("value"), "doc_id").orderBy("doc_id").select("value").write.mode("overwrite").option("compression", codec).text(path)
    made = digests.tree(docs, DOCUMENT_COLUMNS)
    digests.save(made, f"{path.rstrip('/')}.digest")
    return {"corpus_id": corpus_id, "source": source, "normalizer_version": NORMALIZER_VERSION, "doc_count": made.docs, "content_sha256": made.root, "digest_bits": made.bits, "retrieved_at": retrieved_at}


def line_manifest(docs: DataFrame, *, corpus_id: str, source: str, retrieved_at: str = "") -> dict[str, Any]:
    """A manifest whose hash is that of the lines in order, for files that must say the same as those of other tools.

    A hash of one long text has one reader: the driver walks the corpus, a partition at a time.
    """
    digest, count = hashlib.sha256(), 0
    for row in docs.orderBy("doc_id").select("doc_id", "text", "title", "court", "date_filed", "source_url").toLocalIterator():
        digest.update((json.dumps(row.asDict(), sort_keys=True, ensure_ascii=False) + "\n").encode())
        count += 1
    return {"corpus_id": corpus_id, "source": source, "normalizer_version": NORMALIZER_VERSION, "doc_count": count, "content_sha256": digest.hexdigest(), "retrieved_at": retrieved_at}


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, DOCUMENT)


def verify_snapshot(spark: SparkSession, path: str, expected: dict[str, Any]) -> DataFrame:
    """The documents, if they are the manifest's; else an error that names documents which differ, where the tree is kept."""
    docs = read_snapshot(spark, path)
    if NORMALIZER_VERSION != expected["normalizer_version"]:
        raise StoreError(f"normalizer_version is {NORMALIZER_VERSION}, not {expected['normalizer_version']}")
    if "digest_bits" not in expected:
        found = line_manifest(docs, corpus_id=expected["corpus_id"], source=expected["source"])
        for name in ("doc_count", "content_sha256"):
            if found[name] != expected[name]:
                raise StoreError(f"{name} is {found[name]}, not {expected[name]}")
        return docs
    now = digests.tree(docs, DOCUMENT_COLUMNS, expected["digest_bits"])
    if now.docs != expected["doc_count"] or now.root != expected["content_sha256"]:
        told, at = "", f"{path.rstrip('/')}.digest"
        if _exists(spark, at):
            kept = digests.load(spark, at)
            if kept.root == expected["content_sha256"]:
                some = digests.faults(kept, now).orderBy("doc_id").limit(5).collect()
                told = ": " + "; ".join(f"{r['doc_id']} {r['problem']} (range {r['range']})" for r in some)
        raise StoreError(f"{now.docs} documents of content {now.root}, not {expected['doc_count']} of {expected['content_sha256']}{told}")
    return docs


def manifest_hash(entry: dict[str, Any]) -> str:
    return sha256_identity(entry)


# ---------------------------------------------------------------- embeddings, rerank scores


def write_embeddings(rows: DataFrame, path: str) -> None:
    """(key, embedding); a key twice is an error."""
    if not rows.groupBy("key").count().where("count > 1").isEmpty():
        raise StoreError("a key occurs twice")
    rows.select("key", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, embedding array<float>").parquet(path)


def write_scores(rows: DataFrame, path: str) -> None:
    """(query_key, compute_ms, passage_key, score) as a line for each query with a map of scores."""
    rows.groupBy("query_key").agg(F.max("compute_ms").alias("compute_ms"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("passage_key", "score")))).alias("scores")).orderBy("query_key").write.mode("overwrite").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    found = read_jsonl(spark, path, "query_key string, compute_ms double, scores map<string,double>")
    return found.select("query_key", "compute_ms", F.explode("scores").alias("passage_key", "score"))


# ---------------------------------------------------------------- golden sets and the review log


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, labels) of a golden set."""
    pairs = read_jsonl(spark, path, PAIR)
    return pairs.select("query_id", "query", "category", F.col("provenance.origin").alias("origin"), "provenance"), pairs.select("query_id", F.explode("labels").alias("l")).select("query_id", "l.*")


def write_golden(pairs: DataFrame, path: str) -> None:
    """Pairs in order of query_id in one file, the same bytes for the same pairs."""
    pairs.orderBy("query_id").coalesce(1).write.mode("overwrite").json(path)


def append_decisions(rows: DataFrame, path: str) -> None:
    """Decisions with their seq, as new files of the log; nothing written before is touched."""
    rows.write.mode("append").json(path)


def append_candidates(rows: DataFrame, path: str) -> None:
    """Candidates as new files; one whose id was written before is an error, and nothing is written."""
    spark = rows.sparkSession
    if not rows.groupBy("candidate_id").count().where("count > 1").isEmpty():
        raise StoreError("a candidate's id occurs twice")
    if _exists(spark, path):
        before = spark.read.schema(rows.select("candidate_id").schema).json(path)
        if not rows.join(before, "candidate_id", "left_semi").isEmpty():
            raise StoreError("a candidate of that id was written before")
    rows.write.mode("append").json(path)


def golden_set_hash(pairs: Iterable[dict[str, Any]]) -> str:
    """Identity of a set: what a reviewer's clock says is no part of it."""
    def payload(pair: dict[str, Any]) -> dict[str, Any]:
        kept = {k: v for k, v in pair["provenance"].items() if k not in ("reviewed_at", "review_seconds")}
        return {k: v for k, v in pair.items() if k != "provenance"} | {"provenance": kept}

    return sha256_identity({"pairs": [payload(p) for p in sorted(pairs, key=lambda p: p["query_id"])]})


# ---------------------------------------------------------------- runs and baselines


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files (pretty JSON, one report each)."""
    return spark.read.schema(RUN).option("multiLine", True).option("mode", "FAILFAST").json(path)


def run_metrics(runs: DataFrame) -> DataFrame:
    """(config, metric, k, mean, ci_low, ci_high, n) of the overall tables."""
    rows = runs.select(F.col("config_name").alias("config"), F.explode("overall").alias("metric", "ks")).select("config", "metric", F.explode("ks").alias("k", "s"))
    return rows.select("config", "metric", F.col("k").cast("int").alias("k"), "s.*")


def run_identity(runs: DataFrame) -> DataFrame:
    """(config, golden_set_hash, corpus_manifest_hash, config_hash) of runs."""
    return runs.select(F.col("config_name").alias("config"), "golden_set_hash", "corpus_manifest_hash", "config_hash")


def write_runs(runs: DataFrame, path: str) -> None:
    """Reports under a folder for each configuration hash; a run replaces its own folder only."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_hash").json(path)


def bless(runs: DataFrame, path: str, reason: str, blessed_at: str) -> None:
    """Freeze runs as the baseline.  A reason is required, and one run for each configuration."""
    if not reason.strip():
        raise StoreError("a baseline needs a reason")
    if not runs.groupBy("config_name").count().where("count > 1").isEmpty():
        raise StoreError("two runs have one configuration's name")
    runs.withColumn("reason", F.lit(reason)).withColumn("blessed_at", F.lit(blessed_at)).write.mode("overwrite").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The runs that were blessed, with reason and time; a baseline without a reason or without runs is an error."""
    found = spark.read.parquet(path)
    facts = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("config_name").alias("names"), F.coalesce(F.bool_and(F.trim("reason") != ""), F.lit(False)).alias("told")).first()
    if not facts["n"] or facts["n"] != facts["names"] or not facts["told"]:
        raise StoreError("not a baseline: it has no runs, a name twice, or no reason")
    return found


# ---------------------------------------------------------------- replace-by-key index


def load_index(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the index keys that rows hold, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_key").parquet(path)


def read_index(spark: SparkSession, path: str, index_key: str) -> DataFrame:
    found = spark.read.parquet(path).where(F.col("index_key") == index_key)
    if found.isEmpty():
        raise StoreError(f"nothing is loaded for {index_key}")
    return found


def loaded_keys(spark: SparkSession, path: str) -> DataFrame:
    """(index_key, n); no rows where nothing was ever loaded."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "index_key string, n long")
    return spark.read.parquet(path).groupBy("index_key").agg(F.count(F.lit(1)).alias("n"))
