"""The regression gate: a run against a blessed baseline, under a policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.config import GatePolicy

#: Drops are exact decimals in policies and binary fractions in runs.
SLACK = 1e-9
IDENTITY = "config string, golden_set_hash string, corpus_manifest_hash string, config_hash string"


def policy_rows(df: DataFrame, policy: GatePolicy) -> DataFrame:
    """(config, ord, metric, k, max_drop): what the policy asks of each configuration, in its order."""
    rows = []
    for i, config in enumerate(policy.gated_configs):
        for key, drop in policy.max_absolute_drop.items():
            metric, _, k = key.rpartition("_at_")
            rows.append((config, i, metric, int(k), float(drop)))
    return df.sparkSession.createDataFrame(rows, "config string, ord int, metric string, k int, max_drop double")


def _difference(a: str, b: str) -> Column:
    """a - b without the noise of sums, and never a negative zero."""
    return F.round(F.col(a) - F.col(b), 12) + F.lit(0.0)


def regressions(policy: DataFrame, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(config, metric, k, base, now, drop, max_drop, outcome); runs: (config, metric, k, mean).

    outcome is unreported where a run lacks the metric, regression where the drop is more than allowed, else ok.
    """
    b = baseline.select("config", "metric", "k", F.col("mean").alias("base"))
    c = current.select("config", "metric", "k", F.col("mean").alias("now"))
    drop = _difference("base", "now")
    outcome = F.when(F.col("base").isNull() | F.col("now").isNull(), "unreported").when(drop > F.col("max_drop") + SLACK, "regression").otherwise("ok")
    return policy.join(b, ["config", "metric", "k"], "left").join(c, ["config", "metric", "k"], "left").select("config", "ord", "metric", "k", "base", "now", drop.alias("drop"), "max_drop", outcome.alias("outcome"))


def identity_failures(policy: GatePolicy, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(config, failures, warnings): hashes in which the runs differ though the policy wants them equal."""
    b = baseline.select("config", *[F.col(c).alias("b_" + c) for c in ("golden_set_hash", "corpus_manifest_hash", "config_hash")])
    joined = current.join(b, "config")
    differ = {c: ~F.col(c).eqNullSafe(F.col("b_" + c)) for c in ("golden_set_hash", "corpus_manifest_hash", "config_hash")}
    strict = {"golden_set_hash": policy.require_golden_set_hash_match, "corpus_manifest_hash": policy.require_corpus_hash_match, "config_hash": policy.config_hash_mismatch == "fail"}
    pick = lambda want: F.array_compact(F.array(*[F.when(differ[c], c) for c in differ if strict[c] == want] or [F.lit(None).cast("string")]))
    return joined.select("config", pick(True).alias("failures"), pick(False).alias("warnings"))


def evaluate(policy: GatePolicy, baseline: DataFrame, current: DataFrame, baseline_id: DataFrame, current_id: DataFrame) -> DataFrame:
    """(ord, config, status, n_failures, warnings) for each gated configuration, in the policy's order.

    Not in the baseline: skipped_no_baseline (passes).  In the baseline but not run, or any failure: failed.
    """
    asked = policy_rows(current, policy)
    bad = regressions(asked, baseline, current).groupBy("config").agg(F.count_if(F.col("outcome") != "ok").alias("bad"))
    identity = identity_failures(policy, baseline_id, current_id)
    configs = asked.select("config", "ord").distinct()
    flags = configs.join(baseline_id.select("config", F.lit(True).alias("in_base")), "config", "left").join(current_id.select("config", F.lit(True).alias("in_now")), "config", "left")
    out = flags.join(bad, "config", "left").join(identity, "config", "left")
    n = F.coalesce("bad", F.lit(0)) + F.coalesce(F.size("failures"), F.lit(0))
    status = F.when(F.col("in_base").isNull(), "skipped_no_baseline").when(F.col("in_now").isNull() | (n > 0), "failed").otherwise("passed")
    failures = F.when(F.col("in_base").isNull(), 0).when(F.col("in_now").isNull(), 1).otherwise(n)
    return out.select("ord", "config", status.alias("status"), failures.cast("long").alias("n_failures"), F.coalesce(F.array_join("warnings", ","), F.lit("")).alias("warnings")).orderBy("ord")


def verdict_text(rows: DataFrame) -> DataFrame:
    """Regressions with one line of text each."""
    told = F.format_string("%s %s@%d: %.3f -> %.3f (%+.3f, limit -%.3f)", "config", "metric", "k", "base", "now", _difference("now", "base"), "max_drop")
    return rows.withColumn("verdict", F.when(F.col("outcome") == "unreported", F.format_string("%s %s@%d: not reported", "config", "metric", "k")).otherwise(told))
