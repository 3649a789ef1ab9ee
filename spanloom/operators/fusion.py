"""Reciprocal rank fusion, the rerank stage and the assembly of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ranking import top_n


def full_outer_arms(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, chunk_id, dense_rank, lexical_rank, dense, lexical): null where an arm lacks the chunk."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense"))
    x = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical"))
    return d.join(x, ["query_id", "chunk_id"], "full")


def reciprocal_rank(arms: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score): the sum over arms of 1 / (k + rank); an arm without the chunk adds nothing.

    A chunk that one arm has twice is an error.
    """
    if k < 1 or not arms:
        raise ValueError("fusion takes an arm and k above 0")
    named = [a.select("query_id", "chunk_id", F.struct(F.lit(i).alias("arm"), (1.0 / (k + F.col("rank"))).alias("part")).alias("p")) for i, a in enumerate(arms)]
    # added in the order of the arms, so the sum is the same whatever the shuffle brings first
    parts = F.array_sort(F.collect_list("p"))
    grouped = reduce(DataFrame.unionByName, named).groupBy("query_id", "chunk_id").agg(parts.alias("parts"))
    twice = F.size(F.array_distinct(F.transform("parts", lambda p: p["arm"]))) < F.size("parts")
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"])
    refused = F.raise_error(F.concat(F.lit("twice in one arm: "), F.col("query_id").cast("string"), F.lit(" / "), F.col("chunk_id").cast("string"))).cast("double")
    return grouped.select("query_id", "chunk_id", F.when(twice, refused).otherwise(total).alias("score"))


def missing_pairs(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs to rerank that a store of scores (query_id, chunk_id, score) lacks."""
    return ranked.select("query_id", "chunk_id").join(scores, ["query_id", "chunk_id"], "left_anti")


def rerank(ranked: DataFrame, scores: DataFrame, top_n_in: int, top_k: int) -> DataFrame:
    """The first top_n_in of a ranking in the order of other scores, then the first top_k; the rest is dropped.

    A pair without a score is an error, all at once, and never a score of zero.
    """
    pool = ranked.where(F.col("rank") <= top_n_in).select("query_id", "chunk_id")
    known = pool.join(scores.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left")
    checked = F.when(F.col("score").isNull(), F.raise_error(F.concat(F.lit("no rerank score for "), F.col("query_id").cast("string"), F.lit(" / "), F.col("chunk_id").cast("string"))).cast("double")).otherwise(F.col("score"))
    return top_n(known.withColumn("score", checked), top_k)


def assemble(ranked: DataFrame, dense: DataFrame, lexical: DataFrame | None = None, fused: DataFrame | None = None, reranked: DataFrame | None = None) -> DataFrame:
    """Results with the score of each stage; null where a stage did not run or did not have the chunk."""
    out = ranked.select("query_id", "chunk_id", "rank")
    for name, arm in (("dense", dense), ("lexical", lexical), ("fused", fused), ("rerank", reranked)):
        if arm is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
        else:
            out = out.join(arm.select("query_id", "chunk_id", F.col("score").alias(name)), ["query_id", "chunk_id"], "left")
    return out
