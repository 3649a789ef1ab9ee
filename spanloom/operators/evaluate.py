"""Runs: the scores of whole configurations, side by side in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import aggregate, relevance

_APART = "\x1f"


def _keyed(config: Column, query_id: Column) -> Column:
    return F.concat(config, F.lit(_APART), query_id.cast("string"))


def config_scores(results: DataFrame, labels: DataFrame, queries: DataFrame, configs: list[str], k_values: tuple[int, ...] = relevance.K_VALUES) -> DataFrame:
    """(config, query_id, category, origin, k, recall, mrr, ndcg) of every configuration and query with a relevant label.

    results: (config, query_id, chunk_id, doc_id, char_start, char_end, rank), as deep as each configuration's own
    truncation.  A configuration without results scores 0 for a query, it does not lose it.  The labelled set, which is
    small beside results, is repeated for each configuration, and all are scored at once.
    """
    names = F.explode(F.array(*[F.lit(c) for c in configs])).alias("config")
    own = lambda df: df.select("*", names).withColumn("query_id", _keyed(F.col("config"), F.col("query_id"))).drop("config")
    scores = relevance.query_scores(results.withColumn("query_id", _keyed(F.col("config"), F.col("query_id"))).drop("config"), own(labels), own(queries), k_values)
    parts = F.split("query_id", _APART, 2)
    return scores.select(parts[0].alias("config"), parts[1].alias("query_id"), "category", "origin", "k", "recall", "mrr", "ndcg")


def _long(scores: DataFrame) -> DataFrame:
    return scores.unpivot(["config", "query_id", "category", "origin", "k"], ["recall", "mrr", "ndcg"], "metric", "value")


def report(scores: DataFrame) -> DataFrame:
    """(config, grp_type, grp, metric, k, mean, n) of config_scores, in one pass: overall, by category and by origin."""
    own = ["config", "metric", "k"]
    sets = _long(scores).groupingSets([own, ["category", *own], ["origin", *own]], "category", "origin", *own).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping("category").alias("no_category"), F.grouping("origin").alias("no_origin"))
    kind = F.when(F.col("no_category") == 0, "category").when(F.col("no_origin") == 0, "origin").otherwise("overall")
    return sets.select("config", kind.alias("grp_type"), F.when(F.col("no_category") == 0, F.col("category")).when(F.col("no_origin") == 0, F.col("origin")).otherwise("all").alias("grp"), "metric", "k", "mean", "n")


def intervals(scores: DataFrame) -> DataFrame:
    """(config, metric, k, mean, ci_low, ci_high, n) of config_scores."""
    return aggregate.bootstrap(_long(scores), by=("config", "metric", "k"))


def group_intervals(scores: DataFrame) -> DataFrame:
    """(config, grp_type, grp, metric, k, mean, ci_low, ci_high, n) of config_scores, for the groups of ``report``."""
    pair = lambda kind, name: F.struct(F.lit(kind).alias("t"), name.alias("g"))
    groups = F.explode(F.array(pair("overall", F.lit("all")), pair("category", F.col("category")), pair("origin", F.col("origin")))).alias("x")
    rows = _long(scores).select("config", F.col("query_id"), "metric", "k", "value", groups).select("config", F.col("x.t").alias("grp_type"), F.col("x.g").alias("grp"), "query_id", "metric", "k", "value")
    return aggregate.bootstrap(rows, by=("config", "grp_type", "grp", "metric", "k"))


def reports(scores: DataFrame, identity: DataFrame, counts: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """A run report for each configuration, as run files hold it.

    identity: (config, config_hash, golden_set_hash, corpus_manifest_hash, code_version); counts: one row (n_queries,
    n_skipped); latency: (config, stages...).  A configuration that scored no query still has its report, with empty tables.
    The fingerprint is SHA-256 of the four hashes.
    """
    summary = F.struct("mean", "ci_low", "ci_high", "n")
    entries = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    ks = group_intervals(scores).groupBy("config", "grp_type", "grp", "metric").agg(entries(F.col("k").cast("string").alias("k"), summary.alias("s")).alias("ks"))
    tables = ks.groupBy("config", "grp_type", "grp").agg(F.map_from_arrays(F.collect_list("metric"), F.collect_list("ks")).alias("table"))
    kinds = tables.groupBy("config").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("grp_type") == t, F.struct("grp", "table")))).alias(c) for t, c in (("overall", "own"), ("category", "by_category"), ("origin", "by_origin"))])
    out = identity.crossJoin(F.broadcast(counts)).join(kinds, "config", "left")
    stages = [] if latency is None else [c for c in latency.columns if c != "config"]
    if stages:
        out = out.join(latency, "config", "left")
    told = F.map_from_arrays(F.array(*map(F.lit, stages)), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in stages])) if stages else F.expr("cast(map() as map<string,double>)")
    fingerprint = F.substring(F.sha2(F.concat_ws("/", "config_hash", "golden_set_hash", "corpus_manifest_hash", "code_version"), 256), 1, 32)
    return out.select(F.col("config").alias("config_name"), "config_hash", "golden_set_hash", "corpus_manifest_hash", "code_version", fingerprint.alias("run_fingerprint"), "n_queries", "n_skipped", F.col("own")["all"].alias("overall"), "by_category", "by_origin", told.alias("latency"))


def query_counts(labels: DataFrame, queries: DataFrame) -> DataFrame:
    """One row (n_queries, n_skipped): a skipped query has no label that counts as relevant."""
    out = relevance.skipped(labels, queries)
    return queries.agg(F.count(F.lit(1)).alias("n_queries")).crossJoin(out.agg(F.count(F.lit(1)).alias("n_skipped")))
