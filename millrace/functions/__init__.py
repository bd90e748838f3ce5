"""Scalar functions and aggregates of the dialect, as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import InvalidArgument, Unsupported
from millrace.types import CharType

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
WIDE = T.DecimalType(38, 0)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS) or isinstance(kind, T.DecimalType) and kind.scale == 0


def is_summable(kind: T.DataType) -> bool:
    return is_integer(kind) or isinstance(kind, (T.BooleanType, CharType))


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType))


def _strlen(args: list[tuple[Column, T.DataType]]) -> tuple[Column, T.DataType]:
    """Length in bytes."""
    column, kind = args[0]
    if not isinstance(kind, T.StringType):
        column = column.cast("string")
    return F.octet_length(column).cast("bigint"), T.LongType()


def extract(part: str, column: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """MINUTE or HOUR of a time."""
    if part not in ("minute", "hour"):
        raise Unsupported(f"EXTRACT({part})")
    if not is_time(kind):
        raise InvalidArgument(f"EXTRACT needs a time, not {kind.simpleString()}")
    time = column.cast("timestamp_ntz")
    return (F.minute(time) if part == "minute" else F.hour(time)).cast("bigint"), T.LongType()


def date_trunc(part: str, column: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """Start of the minute."""
    if part.lower() != "minute":
        raise Unsupported(f"DATE_TRUNC({part!r})")
    if not is_time(kind):
        raise InvalidArgument(f"DATE_TRUNC needs a time, not {kind.simpleString()}")
    return F.date_trunc("minute", column.cast("timestamp_ntz")).cast("timestamp_ntz"), T.TimestampNTZType()


def java_pattern(pattern: str) -> str:
    """An end anchor means the very end, never the place before a last line break."""
    if pattern.endswith("$") and (len(pattern) - len(pattern[:-1].rstrip("\\")) - 1) % 2 == 0:
        return pattern[:-1] + r"\z"
    return pattern


def java_replacement(text: str) -> str:
    r"""``\1`` to ``\9`` name groups; every other character stands for itself."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in "123456789":
            out.append("$" + text[i + 1])
            i += 1
        else:
            out.append("\\" + c if c in "\\$" else c)
        i += 1
    return "".join(out)


def regexp_replace(column: Column, kind: T.DataType, pattern: str, replacement: str) -> tuple[Column, T.DataType]:
    if not isinstance(kind, T.StringType):
        raise InvalidArgument("REGEXP_REPLACE needs a string")
    return F.regexp_replace(column, java_pattern(pattern), java_replacement(replacement)), T.StringType()


SCALARS: dict[str, Callable] = {"STRLEN": _strlen, "LENGTH": _strlen}


def wide(column: Column, kind: T.DataType) -> Column:
    """A summand whose total cannot overflow: 64 bits suffice below 32-bit inputs, else 38 digits."""
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("bigint")
    if isinstance(kind, CharType):
        return F.ascii(column).cast("bigint")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return column.cast("bigint")
    return column.cast(WIDE)


def count(column: Column, distinct: bool) -> Column:
    return F.count_distinct(column) if distinct else F.count(column)


def total(column: Column, kind: T.DataType) -> Column:
    """SUM: 38 digits, 0 over no rows."""
    return F.coalesce(F.sum(wide(column, kind)).cast(WIDE), F.lit(0).cast(WIDE))


def average(column: Column, kind: T.DataType) -> Column:
    """AVG: truncated toward zero, 0 over no rows."""
    s, n = F.sum(wide(column, kind)).cast(WIDE), F.count(column).cast(WIDE)
    quotient = F.when(n > 0, (s - s % n) / n)
    return F.coalesce(quotient.cast(WIDE), F.lit(0).cast(WIDE))
