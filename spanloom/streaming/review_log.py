"""The review log as a stream: the latest decision of each subject, kept up to date as files arrive.

Order is the log's own seq, not arrival or event time, so late files change nothing that a later seq decided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.golden import latest


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def latest_decisions(log: DataFrame) -> DataFrame:
    """Streaming form of the batch rule; write it in complete or update mode."""
    return latest(log)
