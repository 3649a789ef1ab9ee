"""Relevance by span overlap, and Recall, MRR and nDCG at k, for all queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 10)
MIN_RELEVANT_GAIN = 2
#: A chunk covers a span that shares at least so many characters, and at least half of the span.
MIN_OVERLAP_CHARS, MIN_OVERLAP_SHARE = 64, 0.5


def min_overlap(length: Column) -> Column:
    return F.greatest(F.lit(float(MIN_OVERLAP_CHARS)), length * MIN_OVERLAP_SHARE)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def covers(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, doc_id, span_start, span_end, gain, rank, chunk_id) of results that cover labels.

    results: (query_id, chunk_id, doc_id, char_start, char_end, rank); labels: (query_id, doc_id, char_start, char_end,
    gain).  An equi-join on query and document; the overlap is its residual condition.
    """
    spans = labels.select("query_id", "doc_id", F.col("char_start").alias("span_start"), F.col("char_end").alias("span_end"), "gain")
    shared = overlap(F.col("char_start"), F.col("char_end"), F.col("span_start"), F.col("span_end"))
    return results.join(spans, ["query_id", "doc_id"]).where((shared > 0) & (shared >= min_overlap(F.col("span_end") - F.col("span_start")))).select("query_id", "doc_id", "span_start", "span_end", "gain", "rank", "chunk_id")


def query_scores(results: DataFrame, labels: DataFrame, queries: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(query_id, category, origin, k, recall, mrr, ndcg) of queries (query_id, category, origin) with a relevant label.

    A query without results scores 0; one without a label of gain 2 or more is skipped (see skipped).  A span counts at
    the first rank that covers it; a rank that first covers several spans counts its largest gain once.
    """
    spans = labels.select("query_id", "doc_id", F.col("char_start").alias("span_start"), F.col("char_end").alias("span_end"), "gain")
    first = covers(results, labels).groupBy("query_id", "doc_id", "span_start", "span_end", "gain").agg(F.min("rank").alias("first_rank"))
    seen = spans.join(first, ["query_id", "doc_id", "span_start", "span_end", "gain"], "left")
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id", "span_start"))
    # a query's few labels, gathered once for all k
    per_query = seen.withColumn("ideal", ideal).groupBy("query_id").agg(F.collect_list(F.struct("gain", "first_rank", "ideal")).alias("spans"))
    ks = F.explode(F.array(*[F.lit(k) for k in k_values])).alias("k")
    rows = queries.select("query_id", "category", "origin").join(per_query, "query_id").select("*", ks)
    relevant = F.filter("spans", lambda s: s["gain"] >= MIN_RELEVANT_GAIN)
    rows = rows.withColumn("relevant", relevant).where(F.size("relevant") > 0)
    found = F.filter("relevant", lambda s: s["first_rank"] <= F.col("k"))
    ranks = F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: s["first_rank"] <= F.col("k")), lambda s: s["first_rank"])))
    worth = lambda gain: F.pow(F.lit(2.0), gain) - 1
    best = lambda r: F.array_max(F.transform(F.filter("spans", lambda s: s["first_rank"] == r), lambda s: s["gain"]))
    dcg = F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + worth(best(r)) / F.log2(r + 1.0))
    top = F.array_sort(F.transform(F.filter("spans", lambda s: s["ideal"] <= F.col("k")), lambda s: F.struct(s["ideal"].alias("i"), s["gain"].alias("g"))))
    idcg = F.aggregate(top, F.lit(0.0), lambda acc, s: acc + worth(s["g"]) / F.log2(s["i"] + 1.0))
    at = F.array_min(F.transform(found, lambda s: s["first_rank"]))
    return rows.select(
        "query_id", "category", "origin", "k", (F.size(found) / F.size("relevant")).alias("recall"), F.coalesce(1.0 / at, F.lit(0.0)).alias("mrr"), F.when(idcg > 0, dcg / idcg).otherwise(0.0).alias("ndcg")
    )


def skipped(labels: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries that no metric can score: they have no label of gain 2 or more."""
    return queries.join(labels.where(F.col("gain") >= MIN_RELEVANT_GAIN).select("query_id"), "query_id", "left_anti")


def long_form(scores: DataFrame) -> DataFrame:
    """(query_id, category, origin, metric, k, value)."""
    return scores.unpivot(["query_id", "category", "origin", "k"], ["recall", "mrr", "ndcg"], "metric", "value")
