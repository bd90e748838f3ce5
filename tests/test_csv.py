"""CSV dialect, schema files, inference, conversion, command line."""

import datetime as dt
from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from millrace.cli import main
from millrace.errors import InvalidArgument, MalformedData
from millrace.sources import csv_files as c
from millrace.types import read_schema, write_schema


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def only(folder):
    return next(p for p in folder.iterdir() if p.name.startswith("part-")).read_text()


def test_schema_text():
    assert read_schema("id,INT64\n\nname,string,,\n") == [("id", "int64"), ("name", "string")]
    assert write_schema([("a", "int16")]) == "a,int16\n"
    for bad, error in (("", MalformedData), ("a,float\n", InvalidArgument), ("a\n", MalformedData)):
        with pytest.raises(error):
            read_schema(bad)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_dialect(spark, tmp_path, end):
    path = put(tmp_path / "a.csv", "".join(r + end for r in ('1,"a,b"', '2,"x""y"', '3,"l1\nl2"', "4,", '5,ab"c', '6,""')))
    rows = c.read_csv(spark, path, [("id", "int64"), ("s", "string")]).orderBy("id").collect()
    assert [r.s for r in rows] == ["a,b", 'x"y', "l1\nl2", "", 'ab"c', ""]


@pytest.mark.parametrize(
    "kind,good,bad",
    [
        ("bool", ["true", "1", "FALSE"], ["maybe", ""]),
        ("int16", ["-32768", "32767"], ["40000", "+1", "1.0"]),
        ("int32", ["2147483647"], ["2147483648"]),
        ("int64", ["-9223372036854775808"], ["9223372036854775808", " 1"]),
        ("int128", ["9" * 38], ["1e5"]),
        ("date", ["2024-02-29"], ["2024-02-30", "2024-2-9"]),
        ("timestamp", ["2030-12-31T23:59:59.5", "2024-01-01 00:00:00"], ["2024-01-01 24:00:00", "2024-01-01"]),
        ("char", ["a"], ["ab", ""]),
    ],
)
def test_type_matrix(spark, tmp_path, kind, good, bad):
    ok = put(tmp_path / "ok.csv", "".join(f"{g}\n" for g in good))
    assert c.read_csv(spark, ok, [("x", kind)]).filter("x is not null").count() == len(good)
    for i, b in enumerate(bad):
        path = put(tmp_path / f"bad{i}.csv", f'"{b}",1\n')
        with pytest.raises((PySparkException, Py4JJavaError)):
            c.read_csv(spark, path, [("x", kind), ("y", "int64")]).collect()


def test_wrong_width_and_open_quote(spark, tmp_path):
    with pytest.raises((PySparkException, Py4JJavaError)):
        c.read_csv(spark, put(tmp_path / "w.csv", "1,2\n3\n"), [("a", "int64"), ("b", "int64")]).collect()


def test_inference(spark, tmp_path):
    line = "true,1,40000,3000000000,99999999999999999999,2024-02-29,2024-02-29 12:34:56.123456,z,text\n"
    path = put(tmp_path / "i.csv", line + "0,-5,70000,1,1,1970-01-01,1970-01-01T00:00:00,y,more text\n")
    kinds = ["bool", "int16", "int32", "int64", "int128", "date", "timestamp", "char", "string"]
    assert c.infer_schema(spark, path) == [(f"column_{i}", k) for i, k in enumerate(kinds, 1)]


def test_roundtrip(spark, tmp_path):
    text = '1,10,"sec,ond",2024-01-05 10:00:00.5\n2,20,"thi""rd",2024-01-05 10:00:00\n3,30,"line1\nline2",1970-01-01 00:00:00\n4,40,,2024-01-05 10:00:00.000001\n'
    schema = put(tmp_path / "s.csv", "a,int64\nb,int32\nname,string\nt,timestamp\n")
    for codec in ("lz4", "none"):
        out = str(tmp_path / f"p_{codec}")
        c.convert(spark, schema, put(tmp_path / "d.csv", text), out, 2, codec)
        assert c.export(spark, out, str(tmp_path / f"back_{codec}"), single_file=True) == "a,int64\nb,int32\nname,string\nt,timestamp\n"
        assert only(tmp_path / f"back_{codec}") == text
    with pytest.raises(InvalidArgument):
        c.convert(spark, schema, schema, "x", 0)


def test_values(spark, tmp_path):
    path = put(tmp_path / "v.csv", "12345678901234567890123456789012345678,2024-02-29\n")
    row = c.read_csv(spark, path, [("n", "int128"), ("d", "date")]).collect()[0]
    assert row == (Decimal("12345678901234567890123456789012345678"), dt.date(2024, 2, 29))


def test_command_line(spark, tmp_path, capsys):
    data = put(tmp_path / "in.csv", "1,Alice,10\n2,Bob,20\n3,Charlie,30\n")
    schema, parquet = tmp_path / "schema.csv", str(tmp_path / "t")
    assert main(["infer-schema", "--input", data, "--output", str(schema)]) == 0
    assert schema.read_text() == "column_1,int16\ncolumn_2,string\ncolumn_3,int16\n"
    assert main(["convert", "--schema", str(schema), "--input", data, "--output", parquet, "--compression", "none"]) == 0
    assert main(["roundtrip", "--input", parquet, "--schema-output", str(tmp_path / "s2.csv"), "--csv-output", str(tmp_path / "b"), "--single-file"]) == 0
    assert only(tmp_path / "b") == (tmp_path / "in.csv").read_text()
    assert main(["run-query", "--input", parquet, "--output", str(tmp_path / "q"), "--query", "SELECT SUM(column_3), COUNT(*) FROM hits WHERE column_1 > 1"]) == 0
    assert only(tmp_path / "q") == "50,2\n"
    assert main(["run-query", "--input", parquet, "--output", str(tmp_path / "q2"), "--query", "SELECT nope FROM hits"]) == 1
    assert "InvalidArgument" in capsys.readouterr().err


def test_mixed_line_ends_and_odd_records(spark, tmp_path):
    text = '1,a\n2,"b\r\nc"\r\n3,\r4,"x""\n""y"\n5,q"u\r\n6,"\r"\r\r7,end'
    from millrace.sources.csv_records import records

    got = [bytes(r.record).decode() for r in records(spark, put(tmp_path / "m.csv", text)).collect()]
    assert got == ["1,a", '2,"b\r\nc"', "3,", '4,"x""\n""y"', '5,q"u', '6,"\r"', "", "7,end"]
    assert records(spark, put(tmp_path / "e.csv", "")).count() == 0
    with pytest.raises((PySparkException, Py4JJavaError)):
        c.read_csv(spark, put(tmp_path / "o.csv", '1,"open\n2,x\n'), [("a", "int64"), ("b", "string")]).collect()


@pytest.mark.parametrize("size", [16, 61])
def test_splits_may_fall_anywhere(spark, tmp_path, size):
    import csv
    import io
    import random

    rng = random.Random(size)
    rows = [(str(i), "".join(rng.choice(['"', ",", "\n", "\r\n", "a", "é", " "]) for _ in range(rng.randint(0, 30)))) for i in range(25)]
    rows[20] = ("20", "long\n" * 30)  # spans many splits
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows(rows)
    folder = tmp_path / "files"
    folder.mkdir()
    put(folder / "a.csv", out.getvalue())
    put(folder / "b.csv", out.getvalue().rstrip("\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        cells = c.read_cells(spark, str(folder), 2)
        assert sorted((r.c0, r.c1) for r in cells.collect()) == sorted(rows * 2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_row_groups_are_bounded(spark, tmp_path):
    import pyarrow.parquet as pq

    schema, data = put(tmp_path / "s.csv", "a,int64\nflag,char\n"), put(tmp_path / "d.csv", "".join(f"{i},x\n" for i in range(100)))
    for sizing, most in ((30, 30), (c.Sizing(rows=None, values=40), 20), (c.Sizing(rows=50, values=20), 10), (c.Sizing(rows=None, bytes=1 << 20), 100)):
        out = tmp_path / f"o{most}"
        c.convert(spark, schema, data, str(out), sizing)
        groups = [pq.ParquetFile(p).metadata.row_group(g).num_rows for p in out.glob("part-*") for g in range(pq.ParquetFile(p).metadata.num_row_groups)]
        assert sum(groups) == 100 and max(groups) <= most
    assert c.export(spark, str(out), str(tmp_path / "back")) == "a,int64\nflag,char\n"
    with pytest.raises(InvalidArgument):
        c.convert(spark, schema, data, "x", c.Sizing(bytes=0))
