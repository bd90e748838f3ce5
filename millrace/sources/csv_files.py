"""CSV files in and out, schema inference, conversion to Parquet and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import InvalidArgument, IoFailure, MalformedData
from millrace.operators import record_fsm
from millrace.sources import csv_records
from millrace.types import INFERENCE, SPARK, kind_of, name_of, named, parsed, printed, read_schema, type_name, write_schema

Fields = Sequence[tuple[str, str]]

#: Parquet codec of each accepted compression.
CODECS = {"none": "none", "lz4": "lz4_raw"}
ROWS_PER_GROUP = 16_384


@dataclass(frozen=True)
class Sizing:
    """Bounds of a row group: rows, values (cells), bytes before compression; the tightest one holds."""

    rows: int | None = ROWS_PER_GROUP
    values: int | None = None
    bytes: int | None = None

    def options(self, width: int) -> dict[str, str]:
        """Options of the Parquet writer."""
        if any(x is not None and x < 1 for x in (self.rows, self.values, self.bytes)):
            raise InvalidArgument("a row group needs room for at least one row")
        rows = [x for x in (self.rows, None if self.values is None else max(1, self.values // max(1, width))) if x is not None]
        out = {"parquet.block.row.count.limit": str(min(rows))} if rows else {}
        return out if self.bytes is None else {**out, "parquet.block.size": str(self.bytes)}


def read_cells(spark: SparkSession, path: str, width: int, multi_line: bool = True) -> DataFrame:
    """Headerless CSV as text cells ``c0``...; a wrong number of cells or faulty quoting fails the read.

    Files are split among tasks either way.  ``multi_line`` allows line breaks in
    quoted cells and line ends of any kind, for one more scan of the files and
    cutting in Python; without it, Spark's own reader takes line ends of one kind.
    Rows keep their order inside a split; records across a border come last.
    """
    if multi_line:
        loaded = record_fsm.load_records(csv_records.records(spark, path), "file", "record", [(f"c{i}", "string") for i in range(width)], balance=False)
        fault = F.concat(F.lit("MalformedData: "), F.col("reason"), F.lit(" at byte "), F.col("error_offset").cast("string"), F.lit(" of a record of "), F.col("file"))
        whole = F.when(F.col("reason").isNull(), F.col("record")).otherwise(F.raise_error(fault).cast(loaded.schema["record"].dataType))
        return loaded.select(whole.alias("r")).select("r.*")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    cells = spark.read.csv(path, schema=schema, header=False, escape='"', mode="FAILFAST", maxCharsPerColumn=-1, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True)
    return cells.na.fill("")


def read_csv(spark: SparkSession, path: str, fields: Fields, multi_line: bool = True) -> DataFrame:
    """Typed rows; a cell that its type rejects fails the read."""
    cells = read_cells(spark, path, len(fields), multi_line)
    typed = []
    for i, (name, kind) in enumerate(fields):
        value = parsed(F.col(f"c{i}"), type_name(kind))
        reason = F.concat(F.lit(f"MalformedData: column {name} ({kind}): "), F.col(f"c{i}"))
        typed.append(F.when(value.isNotNull(), value).otherwise(F.raise_error(reason).cast(SPARK[type_name(kind)])))
        typed[-1] = named(typed[-1], name, type_name(kind))
    return cells.select(*typed)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Headerless CSV with minimal quoting: a file for each partition, numbered in the order of rows, or a single one."""
    texts = [printed(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    out = df.select(*texts)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=False, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _first_width(spark: SparkSession, path: str) -> int:
    """Cells of the first record."""
    import csv

    head = spark.read.text(path).limit(1000).collect()
    if not head:
        raise MalformedData("empty file")
    return len(next(csv.reader([r[0] + "\n" for r in head])))


def infer_schema(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """First type in inference order that takes every value of a column, by one aggregation."""
    cells = read_cells(spark, path, _first_width(spark, path))
    tests = [
        F.min(parsed(F.col(c), kind).isNotNull().cast("int")).alias(f"{c}_{kind}") for c in cells.columns for kind in INFERENCE if kind != "string"
    ]
    try:
        fits = cells.agg(*tests).collect()[0]
    except (PySparkException, Py4JJavaError) as e:
        raise MalformedData(str(e).splitlines()[0]) from e
    return [(f"column_{i}", next((k for k in INFERENCE if k == "string" or fits[f"{c}_{k}"] == 1), "string")) for i, c in enumerate(cells.columns, 1)]


def _text(spark: SparkSession, path: str) -> str:
    try:
        return "\n".join(r[0] for r in spark.read.text(path).collect())  # a schema file: a row for each column
    except (PySparkException, Py4JJavaError) as e:
        raise IoFailure(f"cannot read {path}") from e


def load_schema(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return read_schema(_text(spark, path))


def convert(spark: SparkSession, schema_path: str, csv_path: str, out: str, sizing: Sizing | int = ROWS_PER_GROUP, compression: str = "lz4", multi_line: bool = True) -> None:
    """CSV to Parquet; a plain number bounds the rows of a row group."""
    fields = load_schema(spark, schema_path)
    options = (Sizing(sizing) if isinstance(sizing, int) else sizing).options(len(fields))
    if compression not in CODECS:
        raise InvalidArgument(f"unknown compression: {compression}")
    df = read_csv(spark, csv_path, fields, multi_line)
    df.write.mode("overwrite").option("compression", CODECS[compression]).options(**options).parquet(out)


def export(spark: SparkSession, parquet: str, csv_path: str, single_file: bool = False) -> str:
    """Parquet to CSV; returns the text of the schema file."""
    df = spark.read.parquet(parquet)
    write_csv(df, csv_path, single_file)
    return write_schema([(f.name, name_of(kind_of(f))) for f in df.schema.fields])
