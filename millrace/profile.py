"""Switches of the dialect's semantics."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """``compat`` answers like the historical engine where standard SQL differs:
    ``*`` gives four columns of a click table, OFFSET is ignored, and a column
    that only orders a plain SELECT stays in the output."""

    compat: bool = False
    #: The columns that ``*`` gives under ``compat`` if a table has them all.
    star: tuple[str, ...] = ("WatchID", "EventTime", "URL", "Title")
