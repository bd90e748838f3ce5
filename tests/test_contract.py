"""The driver's contract, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


def flat(v):
    return str(v.date() if hasattr(v, "date") and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0) else v)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    want = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = contract.queries()[name](spark, D)
    assert sorted(got.columns) == sorted(columns)
    a = sorted([tuple(flat(v) for v in r) for r in got.select(*columns).collect()])
    b = sorted([tuple(flat(v) for v in r) for r in want.fetchall()])
    assert a == b
