"""Scratch tables and prepared stores: a session without settings, changed tables, clean-up."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from spanloom import queries
from spanloom.sources import scratch

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLAIN = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
known = entry.queries()
for name in sys.argv[2:]:
    print(name, known[name](spark, sys.argv[1]).count(), flush=True)
"""


def run_plain(tmp_path, sf, *names):
    """Counts of queries in a session of another process that has no settings of its own."""
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_") and k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", PLAIN, sf, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    return dict(line.split() for line in done.stdout.splitlines() if len(line.split()) == 2)


def test_a_session_without_settings(tmp_path, sf):
    counts = run_plain(tmp_path, sf, "bm25_top10", "rrf_fused", "chunk_counts", "golden_labels")
    assert len(counts) == 4 and all(int(n) > 0 for n in counts.values())


def test_stores_follow_their_tables(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        shutil.copytree(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet") if os.path.isdir(f"{sf}/{name}.parquet") else shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    d, known = str(tmp_path), queries.queries()
    total = lambda: known["chunk_counts"](spark, d).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).first()
    whole = total()
    half = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 2 = 0").toPandas()
    at = tmp_path / "documents.parquet"
    shutil.rmtree(at) if at.is_dir() else at.unlink()
    half.to_parquet(at)
    spark.catalog.refreshByPath(str(at))
    now = total()
    assert now["docs"] == len(half) < whole["docs"] and now["n"] < whole["n"]


def test_stamp_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_FEW_FILES", 3)
    at = str(tmp_path / "many")
    spark.range(130).repartition(8).write.parquet(at)
    first = scratch.stamp(spark, at)
    assert first == scratch.stamp(spark, at) and len(first) == 4
    spark.range(1).coalesce(1).write.mode("append").parquet(at)
    assert scratch.stamp(spark, at) != first and scratch.stamp(spark, at + "-none") == ()


def test_clean_up_leaves_nothing_that_points_to_deleted_files(spark, sf):
    known = queries.queries()
    before = known["bm25_top10"](spark, sf).collect()
    scratch.materialise(spark.range(3), "gone").createOrReplaceTempView("gone")
    path = scratch.scratch_dir(spark, "named")
    spark.range(5).write.option("path", path).format("parquet").saveAsTable("scratch_named")
    scratch.note_table(spark, "scratch_named")
    assert scratch.clean_up(spark) > 0
    assert not spark.catalog.tableExists("scratch_named")
    assert known["bm25_top10"](spark, sf).collect() == before
    assert scratch.clean_up(spark) > 0 and scratch.clean_up(spark) == 0
