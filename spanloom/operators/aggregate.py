"""Macro averages in one pass of grouping sets, bootstrap intervals, medians of latencies, counts with zero groups."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published runs: resamples, seed, two-sided level.
RESAMPLES, SEED, CONFIDENCE = 1000, 20240101, 0.95
STAGES = ("embed_ms", "dense_ms", "lexical_ms", "fuse_ms", "rerank_ms", "total_ms")
CATEGORIES = ("factual-lookup", "multi-hop", "negation-exclusion", "procedural", "ambiguous-terminology")
ORIGINS = ("human", "llm")


def macro(scores: DataFrame) -> DataFrame:
    """(grp_type, grp, metric, k, mean, n) overall, by category and by origin; scores in long form."""
    view = scores.select("category", "origin", "metric", "k", "value")
    sets = view.groupingSets([["metric", "k"], ["category", "metric", "k"], ["origin", "metric", "k"]], "category", "origin", "metric", "k").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping("category").alias("no_category"), F.grouping("origin").alias("no_origin"))
    kind = F.when(F.col("no_category") == 0, "category").when(F.col("no_origin") == 0, "origin").otherwise("overall")
    return sets.select(kind.alias("grp_type"), F.when(F.col("no_category") == 0, F.col("category")).when(F.col("no_origin") == 0, F.col("origin")).otherwise("all").alias("grp"), "metric", "k", "mean", "n")


def _draws(resamples: int, seed: int):
    """Positions drawn, with replacement, for each number of values; one seeded generator a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("n").to_pylist():
                rng = random.Random(seed)
                step = max(1, 1_000_000 // n)
                for first in range(0, resamples, step):
                    count = min(step, resamples - first)
                    at = [rng.randrange(n) for _ in range(count * n)]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(at), pa.int64()), pa.array([first + i // n for i in range(len(at))], pa.int32()), pa.array(at, pa.int32())], names=["n", "resample", "at"])

    return run


def bootstrap(scores: DataFrame, by: tuple[str, ...] = ("metric", "k"), resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(by..., mean, ci_low, ci_high, n): percentile intervals of the mean over resampled queries.

    The draws depend on the number of values and the seed alone; a task makes them once for each number that occurs, and
    they are joined by position (values in order of query_id).  The interval's ends are order statistics, not interpolated.
    """
    place = Window.partitionBy(*by).orderBy("query_id")
    rows = scores.withColumn("at", F.row_number().over(place) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    sizes = rows.select("n").distinct().where("n > 1").repartition("n")
    plan = sizes.mapInArrow(_draws(resamples, seed), "n long, resample int, at int")
    # few bytes, but resamples times as many rows once joined: both sides are dealt by number, so they are not put into one task
    session = scores.sparkSession
    parts = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda df: df.repartition(parts, "n", "at")
    means = dealt(rows.select(*by, "n", "at", "value")).join(dealt(plan), ["n", "at"]).groupBy(*by, "resample").agg(F.avg("value").alias("m"))
    low, high = int((1 - CONFIDENCE) / 2 * resamples), min(resamples - 1, int((1 + CONFIDENCE) / 2 * resamples))
    ends = means.groupBy(*by).agg(F.sort_array(F.collect_list("m")).alias("ms")).select(*by, F.get("ms", F.lit(low)).alias("low"), F.get("ms", F.lit(high)).alias("high"))
    whole = rows.groupBy(*by).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return whole.join(ends, list(by), "left").select(*by, "mean", F.coalesce("low", "mean").alias("ci_low"), F.coalesce("high", "mean").alias("ci_high"), "n")


def latency_medians(latencies: DataFrame, by: tuple[str, ...] = (), stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Median of each stage; 0 where nothing ran."""
    return latencies.groupBy(*by).agg(*[F.coalesce(F.median(s), F.lit(0.0)).alias(s) for s in stages])


def counts_with_zero(queries: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n) for every value, those without a query too."""
    dim = queries.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return dim.join(queries.groupBy(column).agg(F.count(F.lit(1)).alias("c")), column, "left").select(column, F.coalesce("c", F.lit(0)).alias("n"))
