"""Stores of model outputs: keys asked for, keys missing, computing only what is missing, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MissingKeysError(LookupError):
    """A store lacks keys that a run needs."""


def distinct_texts(*frames: DataFrame) -> DataFrame:
    """(text): the set of texts of all frames."""
    out = frames[0].select("text")
    for f in frames[1:]:
        out = out.union(f.select("text"))
    return out.distinct()


def misses(asked: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    return asked.select(key).distinct().join(store.select(key), key, "left_anti")


def cached_only(asked: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """asked with what the store has; an error that counts all misses, never a computation."""
    n = misses(asked, store, key).count()
    if n:
        raise MissingKeysError(f"{n} keys are not in the store")
    return asked.join(store, key)


def fill(asked: DataFrame, store: DataFrame, compute, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The store with what was missing, and a report (total, unique, reused, computed).

    compute: rows of asked, one for each missing key, to (key, ...) as in the store.
    """
    todo = asked.dropDuplicates([key]).join(store.select(key), key, "left_anti")
    made = compute(todo)
    whole = store.unionByName(made)
    report = asked.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(key).alias("unique")).crossJoin(todo.agg(F.count(F.lit(1)).alias("computed"))).withColumn("reused", F.col("unique") - F.col("computed"))
    return whole, report.select("total", "unique", "reused", "computed")


def refresh_scores(asked: DataFrame, store: DataFrame, compute) -> DataFrame:
    """Rerank scores (query_key, passage_key, score): a query with any pair missing is computed anew as a whole."""
    lacking = asked.join(store, ["query_key", "passage_key"], "left_anti").select("query_key").distinct()
    made = compute(asked.join(lacking, "query_key", "left_semi"))
    return store.join(made.select("query_key", "passage_key"), ["query_key", "passage_key"], "left_anti").unionByName(made)


def check_store(store: DataFrame, dimension: int, key: str = "key", vector: str = "embedding") -> DataFrame:
    """One row: rows, keys, sizes of vectors, and whether the store is sound."""
    facts = store.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"))
    return facts.withColumn("sound", (F.col("n_rows") == F.col("n_keys")) & (F.col("min_dim") == dimension) & (F.col("max_dim") == dimension))


def score_counts(store: DataFrame) -> DataFrame:
    """One row (n_queries, pair_count) of rerank scores (query_key, passage_key, score)."""
    return store.groupBy("query_key").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("pair_count"))
