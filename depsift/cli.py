"""Command line: ``python -m depsift.cli search TABLE [options]`` and the like."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from depsift.operators.estimate import fit_temperature
from depsift.operators.profile import profile
from depsift.operators.tokens import row_key, split_of, tokens
from depsift.plans.search import search
from depsift.settings import Settings
from depsift.sources.rules import evaluate_rules, prepared, read_rules, write_results
from depsift.sources.tables import first_rows, read


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="depsift")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("profile", "preprocess", "calibrate", "search"):
        p = commands.add_parser(name)
        p.add_argument("table")
        p.add_argument("--columns", nargs="*")
        p.add_argument("--key", nargs="*", help="columns that tell rows apart; all by default")
        p.add_argument("--sample-rows", type=int)
        p.add_argument("--continuous-bins", type=int, default=32)
        p.add_argument("--null-literals", nargs="*", default=[])
        p.add_argument("--mode", default="balanced")
        p.add_argument("--output", default="depsift-out")
        if name in ("preprocess", "calibrate"):
            p.add_argument("--force", action="store_true", help="build again, whatever the manifest says")
        if name == "calibrate":
            p.add_argument("--lhs", nargs="+", required=True)
            p.add_argument("--rhs", required=True)
        if name == "search":
            p.add_argument("--truth", help="file of rules to compare with")
            p.add_argument("--target")
            p.add_argument("--rhs-limit", type=int, help="look for so many right sides only, the first in the table")
            p.add_argument("--no-tuning", action="store_true", help="keep the default thresholds")
            p.add_argument("--all-candidates", action="store_true", help="count those that sketches rule out, too")
            for option in ("support_beta", "min_support_count", "min_s_ent", "min_s_acc", "min_score", "score_alpha", "min_direction_margin", "delta_gain", "max_lhs_size", "beam_width", "max_support_rows"):
                p.add_argument("--" + option.replace("_", "-"), type=int if option in ("min_support_count", "max_lhs_size", "beam_width", "max_support_rows") else float)
            for option in ("lhs_allow", "lhs_block", "rhs_allow", "rhs_block"):
                p.add_argument("--" + option.replace("_", "-"), nargs="*")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("depsift").getOrCreate()
    df = read(spark, args.table, args.columns)
    key = args.key or df.columns
    if args.sample_rows:
        df = first_rows(df, args.sample_rows, *key)
    if args.command == "profile":
        profile(df, mode=args.mode).show(1000, truncate=False)
        return 0
    if args.command in ("preprocess", "calibrate"):
        options = {"bins": args.continuous_bins, "null_literals": args.null_literals, "key": key, "mode": args.mode}

        def build(rows):
            kinds = {r["column"]: r["model_type"] for r in profile(rows, mode=args.mode).collect()}
            return tokens(rows.withColumn("split", split_of(row_key(*key))), kinds, bins=args.continuous_bins, null_literals=tuple(args.null_literals))

        table = prepared(df, args.output, options, build, force=args.force)
        if args.command == "calibrate":
            train, val = (table.where(f"split = '{s}'") for s in ("train", "val"))
            print(json.dumps({"temperature": fit_temperature(train, val, args.lhs, args.rhs)}))
        else:
            table.groupBy("split").count().show()
        return 0
    given = {k: (tuple(v) if isinstance(v, list) else v) for k, v in vars(args).items() if k in Settings.names() and v is not None}
    if args.rhs_limit is not None and "rhs_allow" not in given:
        given["rhs_allow"] = tuple(c for c in df.columns if c not in key)[: args.rhs_limit]
    result = search(df, Settings(**given), key_columns=key, target=args.target, tune=not args.no_tuning, screen=not args.all_candidates, null_literals=tuple(args.null_literals))
    scores = evaluate_rules(result.dependencies, read_rules(args.truth)) if args.truth else (0.0, 0.0, 0.0)
    write_results(args.output, result, scores)
    for lhs, rhs in result.dependencies:
        print(f"{','.join(lhs)}->{rhs}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
