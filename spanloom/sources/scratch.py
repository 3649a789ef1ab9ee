"""Tables between two steps: plain Parquet in the shared folder that the session names in ``spark.checkpoint.dir``.

A lost executor then costs a re-read, never a recomputation from the corpus, and the planner sees true sizes.  Only a
session that runs on one machine may leave the folder unset: it gets a temporary one, which this module remembers for
the application (Spark does not let a running session set it).  On a cluster each executor would write to its own disk
and the driver would find nothing, so there an unset folder is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: By application: its own folder where the session names none, folders and catalog tables made, clean-ups so far.
_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}
_CLEANED: dict[str, int] = {}


def _base(spark: SparkSession) -> str:
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    master = spark.conf.get("spark.master", "local")
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return _OWN[app]


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    path = f"{_base(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write a frame to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def note_table(spark: SparkSession, name: str) -> None:
    """A catalog table over a scratch folder: ``clean_up`` drops it."""
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)


def generation(spark: SparkSession) -> int:
    """How often this application has cleaned up: what was made in an earlier generation is gone."""
    return _CLEANED.get(spark.sparkContext.applicationId, 0)


#: Files that the driver asks about one by one; more are listed by a job.
_FEW_FILES = 100


def stamp(spark: SparkSession, path: str) -> tuple:
    """What a table's files are: names, sizes and times of change; another one after any of them changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ()
    if fs.getContentSummary(at).getFileCount() <= _FEW_FILES:
        found, files = fs.listFiles(at, True), []
        while found.hasNext():
            f = found.next()
            files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(files))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def clean_up(spark: SparkSession) -> int:
    """Delete what this session has written to scratch; the number of folders.  Frames that read them end with this."""
    app = spark.sparkContext.applicationId
    _CLEANED[app] = generation(spark) + 1
    for name in _TABLES.pop(app, []):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    paths = _MADE.pop(app, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)
