"""Command line: build and status. Exit codes: 0 well, 1 a file failed, 2 wrong usage or surroundings."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.config import Config, infer_mode, load_config, parse_size
from folio.engine import Engine, OcrUnavailable, Plan, Report
from folio.operators.reports import first_orphans
from folio.schema import PROBLEMS


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="folio")
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("root")
    mode = build.add_mutually_exclusive_group(required=True)
    mode.add_argument("--mirror", dest="mode", action="store_const", const="mirror")
    mode.add_argument("--in-place", dest="mode", action="store_const", const="in-place")
    build.add_argument("--out")
    build.add_argument("--dry-run", action="store_true")
    # Values that weren't given stay None, so that they don't hide those of a file.
    build.add_argument("--ocr", choices=("auto", "never", "only"))
    build.add_argument("--jobs", type=int)
    for flag in ("force", "prune", "keep-running-heads", "follow-symlinks"):
        build.add_argument(f"--{flag}", action="store_const", const=True)
    build.add_argument("--include-images", dest="include_images", action="store_const", const=True)
    build.add_argument("--no-include-images", dest="include_images", action="store_const", const=False)
    build.add_argument("--max-bytes", type=parse_size)
    build.add_argument("--max-ocr-pages", type=int)
    build.add_argument("--verbose", action="store_true")
    status = commands.add_parser("status")
    status.add_argument("root")
    status.add_argument("--out")
    return out


def _print_plan(plan: Plan) -> None:
    if plan.stale:
        print(f"the last run used the other mode and left {plan.stale} artifacts; --prune deletes them")
    width = min(60, plan.items.agg(F.max(F.length("rel"))).first()[0] or 0)
    for r in plan.items.select("action", "rel", "target", "reason").orderBy("rel").toLocalIterator():
        print((f"{r['action']:<10} {r['rel']:<{width}}" + (f" -> {os.path.relpath(r['target'], plan.config.meta_dir)}" if r["target"] else f" ({r['reason']})" if r["reason"] else "")).rstrip())
    print(", ".join(f"{k} {v}" for k, v in plan.counts().items()) or "nothing to do")
    _print_orphans(plan.orphans)


def _print_orphans(orphans: DataFrame) -> None:
    shown = first_orphans(orphans).collect()
    for r in shown:
        print(f"orphan {r['target']}")
    more = orphans.count() - len(shown)
    if more > 0:
        print(f"and {more} more orphans")


def _print_report(report: Report, config: Config) -> None:
    counts = report.counts()
    print(", ".join(f"{k} {v}" for k, v in counts.items()) or "no files")
    print(f"written {report.written}, orphans {report.left.count()}, pruned {report.gone.count()}" + (f", left of the other mode {report.stale}" if report.stale else ""))
    _print_orphans(report.left)
    if any(counts.get(s) for s in PROBLEMS):
        print(f"see {config.meta_dir}/WARNINGS.md")


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    if not os.path.isdir(args.root):
        print(f"{args.root} is not a folder", file=sys.stderr)
        return 2
    try:
        if args.command == "status":
            config = Config(root=args.root, mode=infer_mode(args.root, args.out), out=args.out)
        else:
            config = load_config(**{k: v for k, v in vars(args).items() if k not in ("command", "dry_run", "verbose")})
    except (ValueError, TypeError) as error:
        print(error, file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master(f"local[{getattr(config, 'jobs', 0) or '*'}]").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark)
    try:
        if args.command == "status":
            _print_report(engine.status(config), config)
            return 0
        done = engine.build(config, dry_run=args.dry_run, on_record=(lambda r: print(f"{r['status']:<10} {r['rel']}")) if args.verbose else None)
    except OcrUnavailable as error:
        print(error, file=sys.stderr)
        return 2
    if isinstance(done, Plan):
        _print_plan(done)
        return 0
    _print_report(done, config)
    return 1 if done.failed else 0


if __name__ == "__main__":
    sys.exit(main())
