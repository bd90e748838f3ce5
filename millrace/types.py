"""Scalar types of schema files: names, Spark types, strict parsing, printing."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import InvalidArgument, MalformedData

SPARK: dict[str, T.DataType] = {
    "int64": T.LongType(), "string": T.StringType(), "bool": T.BooleanType(), "int16": T.ShortType(), "int32": T.IntegerType(),
    "int128": T.DecimalType(38, 0), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "char": T.StringType(),
}


class CharType(T.StringType):
    """A string of exactly one byte, which sums as that byte's value."""


#: Key of a column's metadata that keeps its schema type where Spark has none of its own.
TYPE_KEY = "schema_type"


def kind_of(field: T.StructField) -> T.DataType:
    """A column's type in the dialect."""
    return CharType() if isinstance(field.dataType, T.StringType) and (field.metadata or {}).get(TYPE_KEY) == "char" else field.dataType


def named(column: Column, name: str, kind: str) -> Column:
    """A column of a schema type under its name."""
    return column.alias(name, metadata={TYPE_KEY: kind}) if kind == "char" else column.alias(name)


#: Order in which inference tries the types; the first that fits every value wins.
INFERENCE = ("bool", "int16", "int32", "int64", "int128", "date", "timestamp", "char", "string")

_INTEGER = r"^-?[0-9]+\z"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,6})?\z"


def type_name(text: str) -> str:
    """Canonical type name, whatever its case."""
    name = text.strip().lower()
    if name not in SPARK:
        raise InvalidArgument(f"unknown type: {text}")
    return name


def parsed(text: Column, name: str) -> Column:
    """The typed value of a text cell, null if the type rejects it."""
    if name == "string":
        return text
    if name == "char":
        return F.when(F.octet_length(text) == 1, text)
    if name == "bool":
        low = F.lower(text)
        return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))
    if name == "date":
        return F.when(text.rlike(_DATE), text.try_cast("date"))
    if name == "timestamp":
        return F.when(text.rlike(_TIMESTAMP), text.try_cast("timestamp_ntz"))
    return F.when(text.rlike(r"^[+-]?[0-9]+\z" if name == "int128" else _INTEGER), text.try_cast(SPARK[name].simpleString()))


def printed(column: Column, kind: T.DataType) -> Column:
    """Text of a value as the CSV writer puts it; trailing zeros of a second's fraction go."""
    return column.cast("string") if not isinstance(kind, T.StringType) else column


def name_of(kind: T.DataType) -> str:
    """Type name of a type in the dialect."""
    if isinstance(kind, CharType):
        return "char"
    for name, spark in SPARK.items():
        if type(spark) is type(kind) and name != "char":
            return name
    if isinstance(kind, T.TimestampType):
        return "timestamp"
    raise InvalidArgument(f"no schema type for {kind.simpleString()}")


def read_schema(text: str) -> list[tuple[str, str]]:
    """``(name, type)`` of each row of a schema CSV; blank lines and trailing empty cells are skipped."""
    out = []
    for row in csv.reader(io.StringIO(text)):
        while row and not row[-1].strip():
            row.pop()
        if not row:
            continue
        if len(row) != 2:
            raise MalformedData(f"a schema row needs a name and a type: {row}")
        out.append((row[0], type_name(row[1])))
    if not out:
        raise MalformedData("empty schema")
    return out


def write_schema(fields: Iterable[tuple[str, str]]) -> str:
    """Schema CSV text."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(fields)
    return out.getvalue()


def struct(fields: Iterable[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(name, SPARK[kind]) for name, kind in fields])
