"""corpusmill status | inspect | report | publish"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def status(spark: SparkSession, args: argparse.Namespace) -> str:
    from .plans.manifest import render_status, status

    return render_status(status(spark, args.folder).collect())  # a row a stage


def inspect(spark: SparkSession, args: argparse.Namespace) -> str:
    from .operators.formatters import preview
    from .operators.split import sample, select
    from .sources.readers import read_documents

    rows = select(read_documents(spark, args.folder), **{k: getattr(args, k) for k in ("grep", "domain", "reason")})
    key = "id" if "id" in rows.columns else "doc_id"
    rows = sample(rows, args.sample, args.seed, key) if args.sample else rows.limit(args.limit)
    shown = []
    for r in rows.collect():  # as many as asked for
        r = r.asDict()
        tags = " ".join(f"[{k}={r[k]}]" for k in ("filter_reason", "language", "url") if r.get(k) is not None)
        shown.append(f"{r.get(key)} {tags}\n{preview(r['text'] or '', args.width)}")
    return "\n\n".join(shown)


def report(spark: SparkSession, args: argparse.Namespace) -> str:
    from .plans.recipes import ENGLISH_STEPS
    from .plans.report import build_report, render_report, save_report

    verdicts = spark.read.parquet(args.folder)
    steps = args.steps.split(",") if args.steps else ENGLISH_STEPS
    rows = build_report(verdicts, steps, args.top)
    if args.out:
        save_report(rows, args.out)
    return render_report(rows.collect())  # a few rows a step


def publish(spark: SparkSession, args: argparse.Namespace) -> str:
    from .operators.verdict import kept, removed
    from .sources.writers import build_preview

    verdicts = spark.read.parquet(args.folder)
    steps = [r["drop_step"] for r in verdicts.where("drop_step is not null").select("drop_step").distinct().collect()]  # a row a step
    gone = {s.replace(" ", "_"): removed(verdicts.where(F.col("drop_step") == s)) for s in sorted(steps)}
    return str(build_preview(kept(verdicts), gone, args.out, args.title))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    commands = parser.add_subparsers(required=True, dest="command")
    for name in ("status", "inspect", "report", "publish"):
        one = commands.add_parser(name)
        one.add_argument("folder")
        if name == "inspect":
            for flag in ("reason", "domain", "grep"):
                one.add_argument(f"--{flag}")
            for flag, default in (("limit", 10), ("sample", 0), ("seed", 0), ("width", 300)):
                one.add_argument(f"--{flag}", type=int, default=default)
        if name == "report":
            one.add_argument("--top", default=20, type=int)
            one.add_argument("--steps")
        if name in ("report", "publish"):
            one.add_argument("--out", required=name == "publish")
        if name == "publish":
            one.add_argument("--title", default="Preview")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    print({"status": status, "inspect": inspect, "report": report, "publish": publish}[args.command](spark, args))


if __name__ == "__main__":
    main()
