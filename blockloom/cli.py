"""Command line: parse a folder, list evaluations, fold a review log."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from blockloom.operators import export, review
from blockloom.plans import pipeline
from blockloom.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockloom")
    sub = p.add_subparsers(dest="command", required=True)
    parse = sub.add_parser("parse", help="files of a folder to blocks, warnings, evaluations and exports")
    parse.add_argument("input")
    parse.add_argument("output")
    parse.add_argument("--run-id", default="run")
    parse.add_argument("--flat", action="store_true", help="only the folder itself")
    states = sub.add_parser("states", help="states of review tasks from their logs")
    states.add_argument("tasks")
    states.add_argument("decisions")
    states.add_argument("output")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("blockloom").getOrCreate()
    if args.command == "parse":
        r = pipeline.parse_directory(spark, args.input, recursive=not args.flat, output_root=args.output)
        for name in ("documents", "blocks", "warnings", "evaluations", "candidates", "failures"):
            sinks.write_stage(getattr(r, name), args.output, name, args.run_id)
        sinks.write_stage(export.document_markdown(r.blocks, r.documents), args.output, "markdown", args.run_id)
    else:
        done = review.task_states(spark.read.json(args.tasks), spark.read.json(args.decisions))
        sinks.write_json(done, args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
