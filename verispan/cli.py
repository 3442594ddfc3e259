"""Command line: the experiment's verbs. Exit code 0 on success, 2 on an error, which goes to stderr."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .doctor import diagnose
from .plans.stages import EVAL_SPLITS, Run
from .sources.artifacts import IntegrityError, migrate, plain
from .sources.config import load_config


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="verispan", description="Token attribution and evaluation on Spark.")
    top.add_argument("--config", default="experiment.yaml", help="experiment file")
    verbs = top.add_subparsers(dest="verb", required=True)
    doctor = verbs.add_parser("doctor", help="check versions, paths and data")
    doctor.add_argument("--model")
    audit = verbs.add_parser("audit-data", help="validate the data and count it")
    audit.add_argument("--no-strict", action="store_true", help="don't require the official counts")
    heads = verbs.add_parser("discover-heads", help="rank a scorer's copy heads")
    extract = verbs.add_parser("extract", help="extract pending features of a split")
    extract.add_argument("--split", required=True, choices=EVAL_SPLITS)
    extract.add_argument("--limit", type=positive)
    extract.add_argument("--num-shards", type=positive, default=1)
    extract.add_argument("--shard-index", type=int, default=0)
    calibrate = verbs.add_parser("calibrate", help="search and freeze the score")
    evaluate = verbs.add_parser("evaluate", help="evaluate frozen scores on test")
    moved = verbs.add_parser("migrate-manifests", help="adopt intact features of other dependencies; a dry run by default")
    moved.add_argument("--apply", action="store_true")
    for verb in (heads, extract, calibrate, evaluate, moved):
        verb.add_argument("--model", required=True)
    compare = verbs.add_parser("compare", help="compare two scorers")
    compare.add_argument("--first", required=True)
    compare.add_argument("--second", required=True)
    everything = verbs.add_parser("run-all", help="all stages of all models")
    everything.add_argument("--model", action="append", dest="models")
    for verb in (heads, extract, everything):
        verb.add_argument("--force", action="store_true")
    return top


def execute(args: argparse.Namespace, spark: SparkSession) -> object:
    config = load_config(args.config)
    run = Run(spark, config)
    if args.verb == "doctor":
        return diagnose(run, args.model)
    if args.verb == "audit-data":
        return run.audit(not args.no_strict)
    if args.verb == "discover-heads":
        return {"heads": run.discover_heads(args.model, args.force)}
    if args.verb == "extract":
        return {"rows": run.extract(args.model, args.split, args.force, args.limit, args.num_shards, args.shard_index)}
    if args.verb == "calibrate":
        return {mode: state.to_dict() for mode, state in run.calibrate(args.model).items()}
    if args.verb == "evaluate":
        return {"metrics": [r.asDict() for r in run.evaluate(args.model).collect()]}
    if args.verb == "compare":
        return {"metrics": [r.asDict() for r in run.compare(args.first, args.second).collect()]}
    if args.verb == "migrate-manifests":
        table = run.features(args.model)
        return {"adopted": migrate(run.store, table.folder, table.depends, args.apply), "applied": args.apply}
    return run.run_all(args.models, args.force)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("verispan").getOrCreate()
    try:
        report = execute(args, session)
    except (ValueError, KeyError, OSError, IntegrityError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    print(json.dumps(plain(report), indent=2, sort_keys=True, ensure_ascii=False))
    return 2 if isinstance(report, dict) and report.get("ok") is False else 0


if __name__ == "__main__":
    sys.exit(main())
