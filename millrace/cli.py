"""Command line: infer-schema, convert, roundtrip, run-query."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from millrace.engine import Engine
from millrace.errors import MillraceError
from millrace.profile import Profile
from millrace.sources import csv_files
from millrace.types import write_schema


#: Names of commands and options are fixed values; single-file and single-line are additions.
def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    infer = commands.add_parser("infer-schema", help="write the schema file of a CSV file")
    infer.add_argument("--input", required=True)
    infer.add_argument("--output", required=True)
    convert = commands.add_parser("convert", help="CSV to Parquet")
    for name in ("schema", "input", "output"):
        convert.add_argument(f"--{name}", required=True)
    convert.add_argument("--row-group-size", type=int, default=csv_files.ROWS_PER_GROUP)
    convert.add_argument("--compression", choices=sorted(csv_files.CODECS), default="lz4")
    convert.add_argument("--single-line", action="store_true", help="no cell holds a line break: Spark's own reader, one scan")
    back = commands.add_parser("roundtrip", help="Parquet to CSV and schema file")
    for name in ("input", "schema-output", "csv-output"):
        back.add_argument(f"--{name}", required=True)
    back.add_argument("--single-file", action="store_true", help="one CSV file, written by one task")
    run = commands.add_parser("run-query", help="SQL over a Parquet table into CSV")
    run.add_argument("--input", required=True)
    run.add_argument("--output", required=True)
    run.add_argument("--table-name", default="hits")
    run.add_argument("--compat", action="store_true")
    run.add_argument("--single-file", action="store_true", help="one CSV file, written by one task")
    text = run.add_mutually_exclusive_group(required=True)
    text.add_argument("--query")
    text.add_argument("--query-file")
    return parser


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    """One command."""
    if args.command == "infer-schema":
        Path(args.output).write_text(write_schema(csv_files.infer_schema(spark, args.input)))
    elif args.command == "convert":
        csv_files.convert(spark, args.schema, args.input, args.output, args.row_group_size, args.compression, not args.single_line)
    elif args.command == "roundtrip":
        Path(args.schema_output).write_text(csv_files.export(spark, args.input, args.csv_output, args.single_file))
    else:
        engine = Engine(spark, Profile(compat=args.compat))
        engine.register_table(args.table_name, args.input)
        csv_files.write_csv(engine.sql(args.query if args.query is not None else Path(args.query_file).read_text()), args.output, args.single_file)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(args, spark)
    except (MillraceError, PySparkException, Py4JJavaError, OSError) as e:
        print(f"{getattr(e, 'code', type(e).__name__)}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
