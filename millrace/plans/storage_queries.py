"""Queries that write and read back: CSV, schema files, inference, conversion both ways.

Each writes below the shared folder of ``spark.checkpoint.dir``, into a folder of
its own, over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import checkpoint_dir, table
from millrace.sources import csv_files
from millrace.types import name_of

#: Columns of the click table that are never null, and text with nulls as empty: a CSV cell cannot be null.
_PLAIN = ("WatchID", "EventTime", "CounterID", "ClientIP", "IsRefresh", "ResolutionWidth")
_TEXT = ("Title", "URL", "Referer")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/storage/{name}-{uuid.uuid4().hex}"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").select(*_PLAIN, *[F.coalesce(c, F.lit("")).alias(c) for c in _TEXT])


def _written(spark: SparkSession, d: str, name: str) -> tuple[str, str, list[tuple[str, str]]]:
    """A folder, the CSV files of the click table in it, and their schema."""
    folder, df = _folder(spark, name), _hits(spark, d)
    csv_files.write_csv(df, f"{folder}/csv")
    return folder, f"{folder}/csv", [(f.name, name_of(f.dataType)) for f in df.schema.fields]


def _schema_file(spark: SparkSession, folder: str, fields: list[tuple[str, str]]) -> str:
    """A schema file in the shared folder."""
    spark.createDataFrame([(f"{n},{t}",) for n, t in fields], "line string").coalesce(1).write.text(f"{folder}/schema")
    return f"{folder}/schema"


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rows to CSV and back, typed."""
    _, path, fields = _written(spark, d, "roundtrip")
    return csv_files.read_csv(spark, path, fields)


def csv_to_columnar(spark: SparkSession, d: str) -> DataFrame:
    """CSV to Parquet under LZ4 with bounded row groups, read back."""
    folder, path, fields = _written(spark, d, "convert")
    csv_files.convert(spark, _schema_file(spark, folder, fields), path, f"{folder}/parquet", csv_files.Sizing(rows=4096))
    return spark.read.parquet(f"{folder}/parquet")


def columnar_to_csv(spark: SparkSession, d: str) -> DataFrame:
    """Parquet to CSV and a schema file, read back as text cells."""
    folder = _folder(spark, "export")
    _hits(spark, d).write.option("compression", csv_files.CODECS["lz4"]).parquet(f"{folder}/parquet")
    csv_files.export(spark, f"{folder}/parquet", f"{folder}/csv")
    names = [*_PLAIN, *_TEXT]
    return csv_files.read_cells(spark, f"{folder}/csv", len(names)).toDF(*names)


def csv_inferred_schema(spark: SparkSession, d: str) -> DataFrame:
    """Types that inference gives the columns of CSV files."""
    _, path, _ = _written(spark, d, "infer")
    return spark.createDataFrame(csv_files.infer_schema(spark, path), "name string, type string")


def schema_file(spark: SparkSession, d: str) -> DataFrame:
    """A schema file written and read."""
    rows = [(r["name"], r["type"]) for r in table(spark, d, "scheme").orderBy("col_no").collect()]  # a row a column
    return spark.createDataFrame(csv_files.load_schema(spark, _schema_file(spark, _folder(spark, "schema"), rows)), "name string, type string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (csv_roundtrip, csv_to_columnar, columnar_to_csv, csv_inferred_schema, schema_file)}


def oracle_sql() -> dict[str, str]:
    text = ", ".join(f"coalesce({c}, '') AS {c}" for c in _TEXT)
    rows = f"SELECT {', '.join(_PLAIN)}, {text} FROM hits"
    # the printed time drops the zeros that end a second's fraction
    cells = [f"rtrim(rtrim(strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS {c}" if c == "EventTime" else f"CAST({c} AS VARCHAR) AS {c}" for c in _PLAIN]
    fits = {"int16": "SMALLINT", "int32": "INTEGER", "int64": "BIGINT"}

    def inferred(i: int, c: str) -> str:
        if c in _TEXT or c == "EventTime":
            return f"SELECT 'column_{i}' AS name, '{'string' if c in _TEXT else 'timestamp'}' AS type"
        kind = f"CASE WHEN min({c}) >= 0 AND max({c}) <= 1 THEN 'bool' " + " ".join(f"WHEN bool_and(try_cast({c} AS {t}) IS NOT NULL) THEN '{n}'" for n, t in fits.items()) + " END"
        return f"SELECT 'column_{i}' AS name, {kind} AS type FROM hits"

    return {
        "csv_roundtrip": rows,
        "csv_to_columnar": rows,
        "columnar_to_csv": f"SELECT {', '.join(cells)}, {text} FROM hits",
        "csv_inferred_schema": " UNION ALL ".join(inferred(i, c) for i, c in enumerate([*_PLAIN, *_TEXT], 1)),
        "schema_file": "SELECT name, lower(type) AS type FROM scheme",
    }
