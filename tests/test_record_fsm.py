"""Record tokenizer against a plain state machine."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.errors import InvalidArgument
from millrace.operators import record_fsm as op

SCHEME = [("WatchID", "int64"), ("Title", "string"), ("at", "timestamp"), ("d", "date"), ("n", "int16")]


def plain(line):
    """Cells, or None if the quoting is faulty."""
    line, cells, i = line or "", [], 0
    while True:
        if line[i : i + 1] == '"':
            i += 1
            value = ""
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                value += line[i:j]
                i = j + 1
                if line[i : i + 1] == '"':
                    value += '"'
                    i += 1
                else:
                    break
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            value = line[i:j]
            i = j
        cells.append(value)
        if i >= len(line):
            return cells
        i += 1


@pytest.mark.parametrize("chunk", [1, 2, 7, 256])
def test_tokens(chunk):
    rng = random.Random(chunk)
    lines = ["", None, '"', '""', '"""', ",", '"a"b', 'a"b', '"a""b",c\n', '"a\nb","', "é,ü", '"é",'] + ["".join(rng.choice('",ab\\\né') for _ in range(rng.randint(0, 12))) for _ in range(500)]
    t = op.Tokens(pa.array(lines, pa.string()), chunk)
    first = np.cumsum(t.cells) - t.cells
    for i, line in enumerate(lines):
        cells = plain(line)
        assert t.bad[i] == (cells is None), line
        if cells is not None:
            got = [t.data[t.cell_start[c] : t.cell_end[c]].decode() for c in range(first[i], first[i] + t.cells[i])]
            assert [g[1:-1].replace('""', '"') if g[:1] == '"' else g for g in got] == cells


CASES = [
    ("1,a,2024-01-01 00:00:00,2024-02-29,5", None, None, None),
    ('"1","a,b",2024-01-01T23:59:59.5,2024-02-29,-32768', None, None, None),
    ('1,"a,2024-01-01 00:00:00,2024-02-29,5', "quoting", 2, None),
    ('1,"a"x,2024-01-01 00:00:00,2024-02-29,5,', "quoting", 5, None),
    ("1,a", "column_count", 3, 3),
    ("1,a,2024-01-01 00:00:00,2024-02-29,5,6", "column_count", 37, 6),
    ("", "column_count", 0, 2),
    (None, "column_count", 0, 2),
    ("1,a,2024-01-01 24:00:00,2024-02-30,5", "invalid_value", 4, 3),
    ("1,a,2024-01-01 00:00:00,2023-02-29,5", "invalid_value", 24, 4),
    ("1,a,2024-01-01 00:00:00.1234567,2024-02-29,5", "invalid_value", 4, 3),
    ("1,a,2024-01-01 00:00:00,2024-02-29,32768", "invalid_value", 35, 5),
    ("9223372036854775808,a,2024-01-01 00:00:00,2024-02-29,5", "invalid_value", 0, 1),
    ("-9223372036854775808,,2024-01-01 00:00:00,2024-02-29,0005", None, None, None),
    (",a,2024-01-01 00:00:00,2024-02-29,5", "invalid_value", 0, 1),
    ("+1,a,2024-01-01 00:00:00,2024-02-29,5", "invalid_value", 0, 1),
    ("١,a,2024-01-01 00:00:00,2024-02-29,5", "invalid_value", 0, 1),
    ("1,é" + "x" * 200_000 + ",2024-01-01 00:00:00,2024-02-29,7\n", "invalid_value", 200_036, 5),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(CASES)], "raw_id int, line string, reason string")
    loaded = op.load_records(df, "raw_id", "line", SCHEME)
    got = {r.raw_id: (r.reason, r.error_offset, r.error_column) for r in op.faults(loaded).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES) if c[1]}
    rows = {r.raw_id: r for r in op.rows(loaded, "raw_id", SCHEME).collect()}
    assert sorted(rows) == [i for i, c in enumerate(CASES) if not c[1]]
    assert rows[1].Title == "a,b" and rows[1].at.microsecond == 500_000 and rows[1].n == -32768
    assert rows[13].WatchID == -(2**63) and rows[13].Title == "" and rows[13].n == 5


def test_other_types_and_limits(spark):
    scheme = [("b", "BOOL"), ("c", "char"), ("x", "int128")]
    df = spark.createDataFrame([(1, f"TRUE,z,{'9' * 38}"), (2, f"0,ab,{'9' * 38}"), (3, f"1,a,{'9' * 39}"), (3, f"1,a,{'9' * 39}")], "id int, l string")
    loaded = op.load_records(df, "id", "l", scheme)
    assert [(r.id, r.error_column) for r in op.faults(loaded).orderBy("id").collect()] == [(2, 2), (3, 3), (3, 3)]
    assert op.rows(loaded, "id", scheme).collect()[0].x == int("9" * 38)
    empty = op.load_records(df.filter("id > 9"), "id", "l", scheme)
    assert empty.count() == 0
    for bad in ([], [("x", "float")]):
        with pytest.raises(InvalidArgument):
            op.load_records(df, "id", "l", bad)


@pytest.mark.parametrize("kind", ["int16", "int64", "int128"])
def test_integers_of_thousands_of_digits(kind):
    words = pa.array(["9" * 5000, "-" + "9" * 5000, "0" * 5000 + "7", "-" + "0" * 5000 + "7", "-0", "12"])
    values, ok = op._parse(kind, words)
    assert ok.tolist() == [False, False, True, True, True, True] and values.to_pylist() == [None, None, 7, -7, 0, 12]


def test_bytes_that_are_no_text(spark):
    """One fault with its offset, all other records loaded."""
    good, bad = b'7,"say ""yes"", ok",2024-02-29 01:02:03,2024-02-29,5', b"8,caf\xe9,2024-02-29 01:02:03,2024-02-29,5"
    rows = [(1, good), (2, bad), (3, b"\xff9,x,2024-02-29 01:02:03,2024-02-29,5"), (4, b'\xff,"open'), (5, "9,é,2024-02-29 01:02:03,2024-02-29,5".encode())]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id bigint, line binary")
    out = op.load_records(df, "id", "line", SCHEME)
    assert [tuple(r) for r in op.faults(out).orderBy("id").collect()] == [(2, "invalid_value", 2, 2), (3, "invalid_value", 0, 1), (4, "quoting", 2, None)]
    assert [r.Title for r in op.rows(out, "id", SCHEME).orderBy("id").collect()] == ['say "yes", ok', "é"]
