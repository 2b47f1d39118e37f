"""python -m samefold COMMAND --engine package.module:function

The function takes a SparkSession and returns an Engine. Commands: backfill, reconcile, doctor, evaluate.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from samefold.sources.catalog import read_pairs


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 where a check of the set-up fails."""
    p = argparse.ArgumentParser(prog="samefold")
    p.add_argument("command", choices=["backfill", "reconcile", "doctor", "evaluate"])
    p.add_argument("--engine", required=True, help="package.module:function of a session that gives the Engine")
    p.add_argument("--kind", help="backfill: this catalog only")
    p.add_argument("--since", help="backfill: items updated since this time")
    p.add_argument("--pairs", help="evaluate: a CSV of labelled pairs")
    p.add_argument("--thresholds", default="45,75")
    p.add_argument("--image-only", action="store_true")
    p.add_argument("--log", help="evaluate: append the verdicts to this log")
    args = p.parse_args(argv)
    module, _, name = args.engine.partition(":")
    spark = spark or SparkSession.builder.appName("samefold").getOrCreate()
    engine = getattr(importlib.import_module(module), name)(spark)
    if args.command == "evaluate":
        if not args.pairs:
            p.error("evaluate needs --pairs")
        print(engine.report(engine.evaluate(read_pairs(spark, args.pairs), args.image_only, args.log), args.thresholds))
        return 0
    if args.command == "doctor":
        checks = engine.doctor().collect()
        for c in checks:
            print(f"[{'ok' if c.ok else 'FAIL'}] {c.name}: {c.detail}")
        return int(not all(c.ok for c in checks))
    done = engine.backfill(args.kind, args.since) if args.command == "backfill" else engine.reconcile()
    for r in done.collect():  # a row for each kind
        print(", ".join(f"{k} {v}" for k, v in r.asDict().items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
