"""Error taxonomy: one exception class for each code."""

from __future__ import annotations


class MillraceError(Exception):
    """Base of all errors; ``code`` is the stable name of the class."""

    code = "Error"

    def __init__(self, message: str, offset: int | None = None) -> None:
        super().__init__(message if offset is None else f"{message} (at byte {offset})")
        self.offset = offset


class InvalidArgument(MillraceError):
    code = "InvalidArgument"


class MalformedData(MillraceError):
    code = "MalformedData"


class NotFound(MillraceError):
    code = "NotFound"


class OutOfRange(MillraceError):
    code = "OutOfRange"


class InconsistentData(MillraceError):
    code = "InconsistentData"


class NumericOverflow(MillraceError):
    code = "Overflow"


class InvalidState(MillraceError):
    code = "InvalidState"


class Unsupported(MillraceError):
    code = "Unsupported"


class IoFailure(MillraceError):
    code = "IoFailure"
