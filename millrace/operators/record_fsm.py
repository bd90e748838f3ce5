"""Delimited records into typed rows, or into the reason why not.

The records of an Arrow batch form one byte buffer.  Only commas, quotes and
record ends can change the state of the tokenizer, so they alone are its
events, each with a flag for other bytes before it.  An event is a function
from state to state.  The events are cut into chunks of equal length; for all
chunks at once the composed function of each is built, a doubling scan
composes those functions across chunks, and with the state at each chunk's
start known a second pass gives the state at every event.  Nothing depends on
where a chunk, a record or a quoted line break falls.

States: 0 at a cell's start, 1 in a bare cell, 2 in a quoted cell, 3 after a
quote in a quoted cell, 4 after bytes that may not follow a closing quote.

Defined results
* A cell that begins with ``"`` is quoted and ends at the next quote that is
  not doubled; any other quote and every backslash are ordinary bytes.
* ``quoting`` outranks ``column_count``, which outranks ``invalid_value``; of
  several invalid cells the leftmost is reported.
* ``error_offset`` counts bytes from the record's start: the opening quote of a
  cell that does not end, the first byte after a closing quote, the start of
  the first surplus cell, the record's end if cells are missing, or the start
  of the invalid cell.  ``error_column`` counts from 1, null for ``quoting``.
* A null record is an empty record: one cell.
* A cell whose bytes are no UTF-8 is invalid, whatever its type; the other records
  load.
* An empty cell is valid for strings only.  A ``char`` is exactly one byte.
* Identical records are separate rows; an empty table gives no rows; columns
  other than the two named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import InvalidArgument
from millrace.session import spread

#: Events per chunk and bytes per buffer.
CHUNK = 256
BUFFER = 1 << 23

COMMA, QUOTE, END, OTHER, SAME = range(5)
STEP = np.array(
    [
        [0, 0, 2, 0, 4],  # comma
        [2, 1, 3, 2, 4],  # quote
        [0, 0, 0, 0, 0],  # record end
        [1, 1, 2, 4, 4],  # a run of other bytes
        [0, 1, 2, 3, 4],  # nothing: pads the last chunk
    ],
    dtype=np.int8,
)


def table_of(step: np.ndarray) -> np.ndarray:
    """Rows 0-2: the event alone; 3-5: other bytes, then the event; 6: padding."""
    return np.vstack([step[:3], step[:3][:, step[OTHER]], step[SAME : SAME + 1]]).astype(np.int8)


_TABLE = table_of(STEP)

_ARROW_TYPE = {
    "int64": pa.int64(), "int32": pa.int32(), "int16": pa.int16(), "int128": pa.decimal128(38, 0), "string": pa.string(),
    "bool": pa.bool_(), "char": pa.string(), "date": pa.date32(), "timestamp": pa.timestamp("us"),
}
_SPARK_TYPE = {
    "int64": "bigint", "int32": "int", "int16": "smallint", "int128": "decimal(38,0)", "string": "string",
    "bool": "boolean", "char": "string", "date": "date", "timestamp": "timestamp_ntz",
}


def _functions(kind: np.ndarray, chunk: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Events by chunk, and for every chunk the state after it for each state before the first one."""
    n = len(kind)
    chunks = -(-n // chunk)
    grid = np.full(chunks * chunk, len(table) - 1, dtype=np.int8)
    grid[:n] = kind
    grid = grid.reshape(chunks, chunk)
    whole = np.tile(np.arange(5, dtype=np.int8), (chunks, 1))
    for j in range(chunk):
        whole = table[grid[:, j][:, None], whole]
    reach = 1
    while reach < chunks:  # whole[i] becomes the composition of chunks 0..i
        later = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.int64), axis=1)
        whole = np.concatenate([whole[:reach], later])
        reach *= 2
    return grid, whole


def composed(kind: np.ndarray, table: np.ndarray = _TABLE, chunk: int = CHUNK) -> np.ndarray:
    """State after all events, for each state before them."""
    return _functions(kind, chunk, table)[1][-1] if len(kind) else np.arange(5, dtype=np.int8)


def states_before(kind: np.ndarray, chunk: int = CHUNK, start: int = 0, table: np.ndarray = _TABLE) -> np.ndarray:
    """State before every event, by composing transition functions across chunks."""
    grid, whole = _functions(kind, chunk, table)
    state = np.full(len(grid), start, dtype=np.int8)
    state[1:] = whole[:-1, start]
    out = np.empty_like(grid)
    for j in range(chunk):
        out[:, j] = state
        state = table[grid[:, j], state]
    return out.reshape(-1)[: len(kind)]


class Tokens:
    """Cells and quoting faults of the records in one buffer."""

    def __init__(self, lines: pa.Array, chunk: int = CHUNK) -> None:
        raw = pc.fill_null(lines, "").cast(pa.large_binary())
        ends_from_zero = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(np.asarray(pc.binary_length(raw)).astype(np.int64), out=ends_from_zero[1:])
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = raw.buffers()[2]
        self.data = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None and len(raw) else b""
        self.start, self.end = ends_from_zero[:-1], ends_from_zero[1:]
        at = self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        self.quotes = np.flatnonzero(at == 34)
        chars = np.flatnonzero((at == 44) | (at == 34))
        # a record's end lies between bytes: doubled positions order it against them
        place = np.concatenate([2 * chars + 1, 2 * self.end])
        what = np.concatenate([np.where(at[chars] == 44, COMMA, QUOTE), np.full(len(self.end), END)]).astype(np.int8)
        order = np.argsort(place, kind="stable")
        what, pos = what[order], place[order] >> 1
        after = pos + (what != END)
        before = np.concatenate([[0], after[:-1]])
        other = pos > before
        state = states_before((what + 3 * other).astype(np.int8), chunk)
        mid = np.where(other, STEP[OTHER][state], state)
        record = np.cumsum(what == END) - (what == END)
        closing = what == END
        final = mid[closing]
        self.bad = (final == 2) | (final == 4)
        n = len(self.start)
        self.bad_at = np.full(n, -1, dtype=np.int64)
        opened = np.full(n, -1, dtype=np.int64)
        opens = (what == QUOTE) & (mid == 0)
        opened[record[opens]] = pos[opens]  # in order: the last opening quote of each record stays
        spilt = other & (state == 3)
        self.bad_at[record[spilt]] = before[spilt]
        open_end = final == 2
        self.bad_at[open_end] = opened[open_end]
        self.bad_at -= self.start
        cuts = (what == COMMA) & ((mid == 0) | (mid == 1) | (mid == 3)) | closing
        self.cell_record, self.cell_end = record[cuts], pos[cuts]
        self.cells = np.bincount(self.cell_record, minlength=n)
        first = np.concatenate([[True], self.cell_record[1:] != self.cell_record[:-1]]) if len(self.cell_record) else np.zeros(0, bool)
        self.cell_start = np.where(first, self.start[self.cell_record], np.concatenate([[0], self.cell_end[:-1] + 1])[: len(first)])


    def values(self, cell: np.ndarray) -> pa.Array:
        """Bytes of cells without their quotes, copied as one array; only cells with doubled quotes are handled singly."""
        start, end = self.cell_start[cell], self.cell_end[cell]
        quoted = (end > start) & (self.bytes[np.minimum(start, max(len(self.bytes) - 1, 0))] == 34) if len(self.bytes) else np.zeros(len(cell), bool)
        start, end = start + quoted, end - quoted
        size = end - start
        offsets = np.zeros(len(cell) + 1, dtype=np.int64)
        np.cumsum(size, out=offsets[1:])
        out = self.bytes[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        array = pa.Array.from_buffers(pa.large_binary(), len(cell), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        doubled = quoted & (np.searchsorted(self.quotes, end) > np.searchsorted(self.quotes, start))
        if doubled.any():
            single = [self.data[a:b].replace(b'""', b'"') for a, b in zip(start[doubled].tolist(), end[doubled].tolist())]
            array = pc.replace_with_mask(array, pa.array(doubled), pa.array(single, pa.large_binary()))
        return array.cast(pa.binary())


def _text(cells: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cells as text, empty where the bytes are none, and where they are."""
    try:
        return cells.cast(pa.string()), np.ones(len(cells), dtype=bool)
    except pa.ArrowInvalid:
        out: list[str] = []
        readable = np.ones(len(cells), dtype=bool)
        for i, cell in enumerate(cells.to_pylist()):
            try:
                out.append(cell.decode())
            except UnicodeDecodeError:
                out.append("")
                readable[i] = False
        return pa.array(out, pa.string()), readable


def _digits(fixed: np.ndarray, start: int, stop: int) -> np.ndarray:
    v = np.zeros(len(fixed), dtype=np.int64)
    for i in range(start, stop):
        v = v * 10 + (fixed[:, i].astype(np.int64) - 48)
    return v


def _days(fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since the epoch of YYYY-MM-DD, and whether the day exists."""
    y, m, d = _digits(fixed, 0, 4), _digits(fixed, 5, 7), _digits(fixed, 8, 10)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (d <= length)
    month = np.where(ok, y * 12 + m - 1 - 1970 * 12, 0).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return month + np.where(ok, d - 1, 0), ok


def _fixed(words: pa.Array, width: int) -> np.ndarray:
    return np.array(words.cast(pa.binary()).to_pylist(), dtype=f"S{width}").view(np.uint8).reshape(-1, width)


def _integer(word: str, digits: int) -> int | None:
    """The value, None if it has more digits; int() refuses texts of thousands of digits."""
    bare = word.lstrip("+-").lstrip("0") or "0"
    if len(bare) > digits:
        return None
    return -int(bare) if word[0] == "-" else int(bare)


def _parse(kind: str, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Typed values (null where invalid) and validity."""
    n = len(words)
    if kind == "string":
        return words, np.ones(n, dtype=bool)
    if kind == "char":
        ok = np.asarray(pc.binary_length(words)) == 1
        return pc.if_else(pa.array(ok), words, pa.scalar(None, pa.string())), ok
    if kind == "bool":
        low = pc.utf8_lower(words)
        yes, no = np.asarray(pc.is_in(low, pa.array(["true", "1"]))), np.asarray(pc.is_in(low, pa.array(["false", "0"])))
        return pa.array(yes, mask=~(yes | no)), yes | no
    shape = {"date": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "timestamp": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?\z"}
    shape["int128"] = r"\A[+-]?[0-9]+\z"
    ok = np.asarray(pc.match_substring_regex(words, shape.get(kind, r"\A-?[0-9]+\z"))).copy()
    at = np.flatnonzero(ok)
    good = words.take(pa.array(at))
    if kind in ("date", "timestamp"):
        fixed = _fixed(good, 10 if kind == "date" else 26)
        value, exists = _days(fixed)
        if kind == "timestamp":
            h, mi, s = _digits(fixed, 11, 13), _digits(fixed, 14, 16), _digits(fixed, 17, 19)
            tail = np.where(fixed[:, 20:26] == 0, 48, fixed[:, 20:26])
            exists &= (h < 24) & (mi < 60) & (s < 60)
            value = ((value * 24 + h) * 60 + mi) * 60 + s
            value = value * 1_000_000 + _digits(tail, 0, 6)
        full = np.zeros(n, dtype=np.int64)
        full[at] = value
        ok[at] = exists
        base = pa.array(full.astype(np.int32) if kind == "date" else full, mask=~ok)
        return base.cast(_ARROW_TYPE[kind]), ok
    if kind == "int128":
        values = [_integer(w, 38) for w in good.to_pylist()]
        ok[at] = [v is not None for v in values]
        full = [None] * n
        for i, v in zip(at.tolist(), values):
            full[i] = v if ok[i] else None
        import decimal

        with decimal.localcontext(prec=40):
            return pa.array([None if v is None else decimal.Decimal(v) for v in full], _ARROW_TYPE[kind]), ok
    bits = int(kind[3:])
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    short = np.asarray(pc.binary_length(good)) <= 18
    value = np.zeros(len(at), dtype=np.int64)
    inside = np.ones(len(at), dtype=bool)
    value[short] = np.asarray(good.filter(pa.array(short)).cast(pa.int64()))
    for i in np.flatnonzero(~short).tolist():
        v = _integer(good[i].as_py(), 19)
        inside[i] = v is not None and low <= v <= high
        value[i] = v if inside[i] else 0
    inside &= (value >= low) & (value <= high)
    full = np.zeros(n, dtype=np.int64)
    full[at] = np.where(inside, value, 0)
    ok[at] = inside
    return pa.array(full, mask=~ok).cast(_ARROW_TYPE[kind]), ok


def _load(lines: pa.Array, kinds: Sequence[str]) -> tuple[list[pa.Array], pa.Array, pa.Array, pa.Array]:
    """Typed columns, reason, offset and column of the fault."""
    t = Tokens(lines)
    n, width = len(t.start), len(kinds)
    reason = np.full(n, None, dtype=object)
    offset, column = t.bad_at.copy(), np.zeros(n, dtype=np.int64)
    miscounted = ~t.bad & (t.cells != width)
    first_cell = np.cumsum(t.cells) - t.cells
    over = miscounted & (t.cells > width)
    offset[over] = t.cell_start[first_cell[over] + width] - t.start[over]
    under = miscounted & ~over
    offset[under] = (t.end - t.start)[under]
    column[miscounted] = np.minimum(t.cells, width)[miscounted] + 1
    column[under] = t.cells[under] + 1
    reason[t.bad], reason[miscounted] = "quoting", "column_count"
    whole = np.flatnonzero(~t.bad & ~miscounted)
    columns: list[pa.Array] = []
    wrong = np.zeros(len(whole), dtype=bool)
    typed = []
    for c, kind in enumerate(kinds):
        cell = first_cell[whole] + c
        words, readable = _text(t.values(cell))
        values, ok = _parse(kind, words)
        if not readable.all():
            ok = ok & readable
            values = pc.if_else(pa.array(readable), values, pa.scalar(None, values.type))
        new = ~ok & ~wrong
        at = whole[new]
        reason[at], column[at], offset[at] = "invalid_value", c + 1, t.cell_start[cell[new]] - t.start[at]
        wrong |= ~ok
        typed.append(values)
    back = np.full(n, -1, dtype=np.int64)
    back[whole[~wrong]] = np.flatnonzero(~wrong)
    index = pa.array(back, mask=back < 0)
    columns = [v.take(index) for v in typed]
    fault = np.array([r is not None for r in reason], dtype=bool)
    none = ~fault
    return (
        columns,
        pa.array(reason.tolist(), pa.string()),
        pa.array(offset, mask=none),
        pa.array(column, pa.int64(), mask=none | (column == 0)),
    )


def scheme_kinds(rows: Sequence[tuple[str, str]]) -> list[str]:
    """Checked, lower-cased type names of ``(name, type)`` rows."""
    kinds = [str(t).strip().lower() for _, t in rows]
    unknown = [k for k in kinds if k not in _SPARK_TYPE]
    if not rows or unknown:
        raise InvalidArgument(f"unknown column types: {unknown}" if rows else "a schema needs at least one column")
    return kinds


def load_records(df: DataFrame, record_id: str, line: str, schema: Sequence[tuple[str, str]], balance: bool = True) -> DataFrame:
    """``record_id``, ``reason``, ``error_offset``, ``error_column`` and the struct ``record``
    with the typed columns of ``schema``; ``reason`` is null exactly for loaded records.
    Without ``balance`` the rows stay where they are, in their order."""
    kinds = scheme_kinds(schema)
    id_field = df.select(F.col(record_id).alias("id"))
    id_type = id_field.schema[0].dataType.simpleString()
    inner = [(f"c{i}", _ARROW_TYPE[k]) for i, k in enumerate(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                base = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, base + BUFFER)))
                part = batch.slice(start, stop - start)
                columns, reason, offset, column = _load(part.column(1), kinds)
                record = pa.StructArray.from_arrays(columns, fields=[pa.field(n, t) for n, t in inner])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), reason, offset.cast(pa.int64()), column, record],
                    names=["id", "reason", "error_offset", "error_column", "record"],
                )
                start = stop

    struct = ", ".join(f"c{i}: {_SPARK_TYPE[k]}" for i, k in enumerate(kinds))
    lines = df.select(F.col(record_id).alias("id"), F.col(line).cast("string").alias("line"))
    out = (spread(lines) if balance else lines).mapInArrow(
        run, f"id {id_type}, reason string, error_offset bigint, error_column bigint, record struct<{struct}>"
    )
    return out.withColumnRenamed("id", record_id)


def faults(loaded: DataFrame) -> DataFrame:
    """Records that do not load."""
    return loaded.filter(F.col("reason").isNotNull()).drop("record")


def rows(loaded: DataFrame, record_id: str, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """Typed rows of the records that load, after their id."""
    fields = [F.col("record")[f"c{i}"].alias(name) for i, (name, _) in enumerate(schema)]
    return loaded.filter(F.col("reason").isNull()).select(F.col(record_id), *fields)
