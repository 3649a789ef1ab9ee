"""Command line over what the engine has: ``python -m spanloom.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from spanloom import __doc__ as about
from spanloom.operators import authoring, gate, golden
from spanloom.plans.config import load_configs, load_policy
from spanloom.sources import stores


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom", description=about)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, help: str, *arguments: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help)
        for a in arguments:
            c.add_argument(a)
        return c

    add("queries", "names of the registered queries")
    add("query", "show the rows of a registered query", "name", "tables").add_argument("--rows", type=int, default=20)
    add("configs", "check a folder of configurations", "folder")
    add("verify", "check a snapshot against its manifest, a JSON file; names documents that differ", "snapshot", "manifest")
    add("template", "an empty form for a pair written by hand")
    add("validate", "labels of a golden set that its documents contradict", "golden", "snapshot")
    add("status", "a review log in numbers", "log", "candidates")
    add("gate", "compare runs with a blessed baseline; exits 1 on a regression", "baseline", "runs", "policy")
    add("bless", "freeze runs as the baseline", "runs", "baseline", "reason", "blessed_at")
    return p


def _show(df: DataFrame, rows: int = 1000) -> None:
    df.show(rows, truncate=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "template":
        print(authoring.template())
        return 0
    if a.command == "configs":
        for name, config in load_configs(a.folder).items():
            print(name, config.config_hash)
        return 0
    from spanloom import queries

    if a.command == "queries":
        print("\n".join(sorted(queries.queries())))
        return 0
    spark = spark or SparkSession.builder.appName("spanloom").getOrCreate()
    if a.command == "query":
        _show(queries.queries()[a.name](spark, a.tables), a.rows)
    elif a.command == "verify":
        try:
            print(stores.verify_snapshot(spark, a.snapshot, json.loads(Path(a.manifest).read_text())).count())
        except stores.StoreError as e:
            print(e)
            return 1
    elif a.command == "validate":
        _, labels = stores.read_golden(spark, a.golden)
        found = golden.validate_labels(labels, stores.read_snapshot(spark, a.snapshot))
        _show(found)
        return int(not found.isEmpty())
    elif a.command == "status":
        _show(golden.review_summary(spark.read.json(a.log), spark.read.json(a.candidates)))
    elif a.command == "bless":
        stores.bless(stores.read_runs(spark, a.runs), a.baseline, a.reason, a.blessed_at)
    elif a.command == "gate":
        policy = load_policy(a.policy)
        sides = [stores.read_baseline(spark, a.baseline), stores.read_runs(spark, a.runs)]
        metrics = [stores.run_metrics(x) for x in sides]
        identity = [stores.run_identity(x) for x in sides]
        verdicts = gate.evaluate(policy, *metrics, *identity)
        _show(verdicts)
        return int(not verdicts.where("status = 'failed'").isEmpty())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
