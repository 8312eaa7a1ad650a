"""Command line: build a corpus from a folder of projects, or combine a produced one.

    python -m proofmill.cli first ROOT -o OUT [--projects A B] [--sample-projects] [--suffix S]
                                              [--skip-comments] [--tree-order] [--named-tests]
    python -m proofmill.cli per-assert ROOT -o OUT ... [--same-package]
    python -m proofmill.cli combine FOLDER -o OUT
    python -m proofmill.cli list ROOT -o OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill import constants as C
from proofmill.operators import files as FO
from proofmill.plans import first_assertion, per_assertion
from proofmill.session import build_session, written_once
from proofmill.sinks import text_pairs
from proofmill.sources import trees


def select_files(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    files = trees.scan_project_tree(spark, args.root, args.suffix)
    if args.projects:
        files = FO.filter_projects(files, args.projects)
    if args.sample_projects:
        files = FO.filter_sample_projects(files)
    return files


def build_first(spark: SparkSession, args: argparse.Namespace) -> None:
    """Parquet with order columns, and one pair of text folders per project."""
    rows = first_assertion.samples(select_files(spark, args), args.suffix, args.skip_comments, args.named_tests, args.tree_order)
    rows.write.parquet(f"{args.output}/samples")
    text_pairs.write_pairs(
        spark.read.parquet(f"{args.output}/samples"), f"{args.output}/text", ["path", "ordinal"]
    )


def build_per_assertion(spark: SparkSession, args: argparse.Namespace) -> None:
    """Parquet, one overall pair of text folders, the two CSV outputs and the reject counts."""
    order = ["path", "ordinal", "split_no"]
    stages = per_assertion.run(
        select_files(spark, args), args.suffix, same_package=args.same_package, skip_comments=args.skip_comments,
        tree_order=args.tree_order,
    )
    stages.splits = written_once(stages.splits, "splits")
    per_assertion.samples(stages.splits, args.skip_comments).write.parquet(f"{args.output}/samples")
    text_pairs.write_pairs(
        spark.read.parquet(f"{args.output}/samples"), f"{args.output}/text", order, by_project=False
    )
    text_pairs.write_inputs(per_assertion.inputs(stages.splits, True, args.skip_comments), args.output, order)
    per_assertion.reject_counts(stages).write.json(f"{args.output}/rejects")
    spark.read.json(f"{args.output}/rejects").orderBy("stage", "reason").show(50, False)


def combine(spark: SparkSession, args: argparse.Namespace) -> None:
    """All numbered projects in number order, one text folder per half."""
    lines = written_once(trees.read_corpus_lines(spark, args.root), "lines")
    for half in ("assert", "prefix_focal"):
        trees.combine(lines.filter(F.col("half") == half)).select("line").write.text(
            f"{args.output}/all_{half}"
        )


def list_tree(spark: SparkSession, args: argparse.Namespace) -> None:
    """Projects of a folder with their numbers of test and source files, as JSON lines; no file is opened."""
    listed = trees.list_project_tree(spark, args.root, args.suffix)
    FO.project_counts(listed).write.json(args.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="proofmill")
    commands = parser.add_subparsers(required=True)
    for name, run in (("first", build_first), ("per-assert", build_per_assertion), ("combine", combine), ("list", list_tree)):
        command = commands.add_parser(name, help=run.__doc__)
        command.set_defaults(run=run)
        command.add_argument("root")
        command.add_argument("-o", "--output", required=True)
        if run is not combine:
            command.add_argument("--suffix", default=C.TEST_SUFFIX)
        if run in (build_first, build_per_assertion):
            command.add_argument("--projects", nargs="+")
            command.add_argument("--sample-projects", action="store_true")
            command.add_argument("--skip-comments", action="store_true", help="pass over assertions that are commented out")
            command.add_argument("--tree-order", action="store_true", help="look at calls in the order of a syntax tree")
        if run is build_first:
            command.add_argument("--named-tests", action="store_true", help="only methods named test and a number")
        if run is build_per_assertion:
            command.add_argument("--same-package", action="store_true", help="find superclasses of the same package")
    args = parser.parse_args(argv)
    args.run(spark or build_session(), args)


if __name__ == "__main__":
    main()
