"""Command line: convert one file, or standard input (``-``), to Parquet."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from sluice.plans.convert import convert
from sluice.sources.stdin import spooled


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice", description="Delimited text to typed Parquet.")
    p.add_argument("input", nargs="?", help="a text file, or - for standard input (written to stdin.parquet)")
    p.add_argument("--full-inference", action="store_true", help="infer types from all rows instead of the first 1000")
    p.add_argument("--single-file", action="store_true", help="write one Parquet file")
    return p


def main(argv: list[str] | None = None, stdin=None) -> int:
    logging.basicConfig(level=os.environ.get("SLUICE_LOG", "INFO").upper())
    p = parser()
    args = p.parse_args(argv)
    stream = stdin if stdin is not None else sys.stdin.buffer
    if not args.input or (args.input == "-" and stream.isatty()):
        p.print_help(sys.stderr)
        return 1
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        options = {"full_inference": args.full_inference, "single_file": args.single_file}
        if args.input == "-":
            with spooled(stream) as path:
                report = convert(spark, path, os.path.join(os.getcwd(), "stdin.parquet"), **options)
        else:
            report = convert(spark, args.input, **options)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{report.output}: {report.rows} rows, {report.ragged} ragged, {report.seconds:.2f} s, {report.micros_per_row:.1f} us/row, {report.rows_per_second:.0f} rows/s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
