"""Records of CSV files that are split among tasks, whatever their quoted cells hold.

Files are read as lines, so a large file has many splits.  A line break inside a
quoted cell may stand anywhere, also at a split's border, and whether a split
begins inside such a cell depends on all text before it.  So each split first
gives the function from the tokenizer's state at its start to that at its end;
composed in order, these give the state at every split's start.  With it a second
pass cuts the records; pieces of a record that crosses borders meet in one
small exchange.

Defined results
* A record ends at LF, CR or CRLF outside quoted cells, in any mix; the break at a
  file's end adds no record, an empty line is a record of one empty cell.
* A quoted cell that a file's end leaves open makes the last record; the tokenizer
  reports it.
* Bytes stay as they are; an empty file has no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import record_fsm as fsm

#: As in a record, but a line's end leaves a quoted cell open.
_STEP = fsm.STEP.copy()
_STEP[fsm.END] = [0, 0, 2, 0, 0]
_TABLE = fsm.table_of(_STEP)


class _Lines:
    """Events of some lines: commas, quotes, and ends (CR or LF)."""

    def __init__(self, lines: list[bytes]) -> None:
        self.data = b"\n".join([*lines, b""])
        at = np.frombuffer(self.data, dtype=np.uint8)
        self.pos = np.flatnonzero((at == 44) | (at == 34) | (at == 10) | (at == 13))
        byte = at[self.pos]
        what = np.where(byte == 44, fsm.COMMA, np.where(byte == 34, fsm.QUOTE, fsm.END)).astype(np.int8)
        other = self.pos > np.concatenate([[0], self.pos[:-1] + 1])
        self.kind = (what + 3 * other).astype(np.int8)
        self.ends = what == fsm.END
        self.mid = other
        # the LF of a CRLF ends nothing of its own
        self.second = np.concatenate([[False], (byte[1:] == 10) & (byte[:-1] == 13) & (self.pos[1:] == self.pos[:-1] + 1)])

    def step(self, states: np.ndarray) -> np.ndarray:
        """States after the lines, for every state before them."""
        return fsm.composed(self.kind, _TABLE)[states]

    def cut(self, state: int) -> tuple[list[bytes], bytes, int]:
        """Records that end here, the rest, and the state after it."""
        before = fsm.states_before(self.kind, start=state, table=_TABLE)
        inside = np.where(self.mid, _STEP[fsm.OTHER][before], before) == 2
        closing = self.ends & ~inside
        stops = self.pos[closing & ~self.second]
        out, start = [], 0
        skip = set((self.pos[closing & self.second]).tolist())
        for stop in stops.tolist():
            out.append(self.data[start:stop])
            start = stop + 1
            if start in skip:
                start += 1
        return out, self.data[start:], int(_TABLE[self.kind[-1], before[-1]])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Lines of one split each, in order."""
    for batch in batches:
        lines = batch.column(0).cast(pa.binary()).to_pylist()
        keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], lines[start:i]
                start = i


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``record`` of every record."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    functions = pa.schema([("file", pa.string()), ("split", pa.int64()), ("after", pa.list_(pa.int8()))])

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], np.ndarray] = {}
        for key, part in _batches(batches):
            known[key] = _Lines(part).step(known.get(key, np.arange(5, dtype=np.int8)))
        columns = [[k[0] for k in known], [k[1] for k in known], [v.tolist() for v in known.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, functions)], schema=functions)

    starts: dict[tuple[str, int], int] = {}
    file, state = None, 0
    for r in lines.mapInArrow(function, "file string, split bigint, after array<tinyint>").orderBy("file", "split").toLocalIterator():  # a row a split
        state = 0 if r["file"] != file else state
        file = r["file"]
        starts[(file, r["split"])] = state
        state = r["after"][state]
    sent = spark.sparkContext.broadcast(starts)
    pieces = pa.schema([("file", pa.string()), ("split", pa.int64()), ("kind", pa.string()), ("record", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, pieces)], schema=pieces)

        key, state, rest, joins = None, 0, b"", False

        def tail() -> list[tuple]:
            # without its last break the rest goes on in the next split; "both" has neither beginning nor end here
            return [(*key, "both" if joins else "tail", rest)] if key is not None and rest else []

        for at, part in _batches(batches):
            out = []
            if at != key:
                out += tail()
                key, state, rest = at, sent.value[at], b""
                joins = state == 2
            found, left, state = _Lines(part).cut(state)
            if found:
                found[0] = rest + found[0]
                out += [(*key, "head" if joins and i == 0 else "whole", r) for i, r in enumerate(found)]
                joins, rest = False, left
            else:
                rest += left
            yield emit(out)
        yield emit(tail() if key is not None else [])

    cuts = lines.mapInArrow(cut, "file string, split bigint, kind string, record binary")
    broken = cuts.filter("kind <> 'whole'")
    owner = F.last(F.when(F.col("kind") == "tail", F.col("split")), ignorenulls=True).over(Window.partitionBy("file").orderBy("split", F.col("kind") == "tail"))
    joined = broken.withColumn("owner", owner).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("split", "record"))).alias("p"))
    joined = joined.select("file", F.concat(F.lit(b""), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["record"]))).alias("record"))
    # an open cell at a file's end keeps the break that the last line was given
    return cuts.filter("kind = 'whole'").select("file", "record").unionByName(joined)
