"""The jobs, for spark-submit: ``python -m blotter <job> --help``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from blotter.functions import as_percentage
from blotter.plans import outcomes, projection, reports, tables, tuning
from blotter.plans.tasks import TASKS
from blotter.schema import KEY
from blotter.session import get_session
from blotter.sources import export_batches, read_incidents, read_table, write_results, write_table
from blotter.staging import release


def _incidents(spark, args):
    return read_incidents(spark, args.input, source=args.source, multiline=args.multiline)


def clean(spark, args) -> None:
    """Drop the raw-only columns and incomplete rows; --parquet writes the typed table by year."""
    raw = read_table(spark, args.input, infer=False, multiline=args.multiline)
    if args.parquet:
        tables.write_canonical(tables.clean(raw), args.output)
    else:
        tables.write_clean(raw, args.output)


def encode(spark, args) -> None:
    """Clean, and replace type and place by word numbers."""
    tables.write_encoded(read_table(spark, args.input, infer=False, multiline=args.multiline), args.output)


def batches(spark, args) -> None:
    """Cut a table into files of a fixed number of rows."""
    keys = None if args.source_order else [args.key]
    export_batches(spark, args.input, args.output, keys, args.size, args.index, args.flat)


def report(spark, args) -> None:
    """All reports and chart tables, as CSV."""
    for name in reports.write_reports(_incidents(spark, args), args.output, args.wide):
        print(name)


def project(spark, args) -> None:
    """Two principal components of an encoded table."""
    found = projection.project(read_table(spark, args.input), args.key)
    write_table(found.points, args.output)
    print(f"Explained variance: {sum(found.components.explained):.4f}")


def outcome(spark, args) -> None:
    """Train one of the prediction tasks; writes the predictions of the test rows, and with --charts the tables of its charts."""
    forest = outcomes.Forest(trees=args.trees, depth=args.depth)
    settings = outcomes.Settings(
        key=args.key,
        fit_on=args.fit_on,
        exclude=tuple(args.exclude),
        numeric=tuple(args.numeric),
        rescale=args.rescale,
        explained=args.explained,
        labelled_rows=args.labelled_rows,
        forest=forest,
    )
    found = outcomes.train_outcome(_incidents(spark, args), TASKS[args.task], settings)
    write_table(found.predictions, args.output)
    if args.charts:
        for name, table in {"confusion": found.confusion(), **found.charts()}.items():
            write_results(table, f"{args.charts}/{name}")
    if found.explained:
        print(f"Explained variance: {sum(found.explained):.4f} by {len(found.explained)} components")
    # Both are null where no test row allows them.
    share = found.accuracy().select(as_percentage(F.col("accuracy"))).first()[0]
    print(f"Accuracy: {share}%")
    if found.task.binary:
        print(f"ROC area: {found.roc_area().first()[0]}")


def tune(spark, args) -> None:
    """Cross-validate the tree for the offence type; writes the result table."""
    found = tuning.tune_type(
        _incidents(spark, args), args.key, fit_on=args.fit_on, parallelism=args.parallelism
    )
    write_results(found.results, args.output)
    print(f"Test F1 of the best tree: {found.test_f1:.6f}")


def sweep(spark, args) -> None:
    """F1 of a tree for the offence type at every point of the sweep; writes the result table."""
    write_results(tuning.sweep_type(_incidents(spark, args), args.key, parallelism=args.parallelism).results, args.output)


JOBS = {f.__name__: f for f in (clean, encode, batches, report, project, outcome, tune, sweep)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="blotter", description="Jobs over incident tables.")
    jobs = top.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        one = jobs.add_parser(name, help=job.__doc__, description=job.__doc__)
        one.add_argument("input")
        one.add_argument("output")
        one.add_argument("--master", help="only for runs without spark-submit")
        one.add_argument("--key", default=KEY)
        one.add_argument("--source", choices=["csv", "parquet"], help="default: told by the files found")
        one.add_argument("--multiline", action="store_true", help="CSV values may run over several lines")
        if job is clean:
            one.add_argument("--parquet", action="store_true")
        if job is batches:
            one.add_argument("--size", type=int, default=30_000)
            one.add_argument("--index", action="store_true")
            one.add_argument("--source-order", action="store_true", help="rows as they stand in the files, not by key")
            one.add_argument("--flat", action="store_true", help="files Batch_<n>.csv instead of folders")
        if job is report:
            one.add_argument("--wide", action="store_true", help="the matrix of all types in tables of a bounded width")
        if job is outcome:
            one.add_argument("--task", choices=sorted(TASKS), required=True)
            one.add_argument("--trees", type=int, default=100)
            one.add_argument("--depth", type=int, default=30)
            one.add_argument("--exclude", nargs="*", default=[])
            one.add_argument("--numeric", nargs="*", default=[], help="columns taken as the numbers they are")
            one.add_argument("--rescale", action="store_true")
            one.add_argument("--explained", type=float, help="as many components as explain more than this share")
            one.add_argument("--labelled-rows", type=int, help="about so many rows to fit the trees on; default: all")
            one.add_argument("--charts", help="folder for the confusion matrix, its heat map and the ROC chart")
        if job in (tune, sweep):
            one.add_argument("--parallelism", type=int, default=2)
        if job in (outcome, tune):
            one.add_argument("--fit-on", choices=["train", "all"], default="all")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_session(f"blotter-{args.job}", args.master)
    try:
        JOBS[args.job](spark, args)
    finally:
        release(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
