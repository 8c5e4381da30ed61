"""python -m lamella.cli COMMAND: cat, head, meta, schema, rowcount, split, csv2parquet, merge."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lamella.functions.handlers import TYPES, bytes_of
from lamella.operators.rows import flat_text, json_text
from lamella.schema.dsl import render
from lamella.sources import footer
from lamella.sources.csv import csv_to_parquet
from lamella.sources.scan import ScanOptions, head, rows, scan
from lamella.sources.sinks import SinkOptions, codecs, merge_files
from lamella.sources.split import FILE_SIZE, ROW_GROUP_SIZE, split


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lamella", description="Tools for columnar files.")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("cat", "head"):
        p = commands.add_parser(name, help="prints rows")
        p.add_argument("path")
        p.add_argument("-n", type=int, default=-1 if name == "cat" else 5, help="rows; -1 for all")
        p.add_argument("--json", action="store_true")
        p.add_argument("--columns", nargs="*", default=[])
    for name in ("meta", "schema", "rowcount"):
        commands.add_parser(name).add_argument("path")
    p = commands.add_parser("split", help="writes files of about one size")
    p.add_argument("path")
    p.add_argument("target")
    p.add_argument("--order", nargs="+", required=True)
    p.add_argument("--file-size", default=FILE_SIZE)
    p.add_argument("--row-group-size", default=ROW_GROUP_SIZE)
    p.add_argument("--compression", default="SNAPPY", choices=codecs())
    p = commands.add_parser("merge", help="writes one file (an extra)")
    p.add_argument("path")
    p.add_argument("target")
    p = commands.add_parser("csv2parquet")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--typehints", default="", help=f"column=type, ...; types: {', '.join(TYPES)}")
    p.add_argument("--delimiter", default=",")
    p.add_argument("--compression", default="SNAPPY", choices=codecs())
    p.add_argument("--rowgroup-size", default="100MB")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The lines that a command prints."""
    if args.command in ("cat", "head"):
        df = head(scan(spark, args.path, ScanOptions(columns=tuple(args.columns))), args.n)
        return [r["line"] for r in rows(json_text(df) if args.json else flat_text(df))]
    if args.command == "rowcount":
        return [f"Total RowCount: {footer.row_count(spark, args.path)}"]
    if args.command == "schema":
        return render(footer.file_schema(args.path)).splitlines()
    if args.command == "meta":
        first = footer.list_files(args.path)[0]
        wide = footer.columns(spark, first).orderBy("index").collect()
        return [f"{r['path']}:\t\t{r['repetition'].upper()} {r['physical'].upper()} R:{r['max_repetition']} D:{r['max_definition']}" for r in wide]
    if args.command == "split":
        split(scan(spark, args.path), args.target, args.order, args.file_size, args.row_group_size, args.compression)
    elif args.command == "merge":
        merge_files(scan(spark, args.path), args.target)
    else:
        csv_to_parquet(spark, args.input, args.output, args.typehints, args.delimiter, SinkOptions(codec=args.compression, row_group_bytes=bytes_of(args.rowgroup_size)))
    return []


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lamella").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        for line in run(spark, args):
            print(line)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
