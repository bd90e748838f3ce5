"""Every training-data query runs on the smallest tables with its columns."""

import os

import pytest

from millrace.llm import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
COLUMNS = {
    "p2_found": ["WatchID", "field"],
    "p3_found": ["stat_date", "key"],
    "p4_found": ["field", "item"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "pii_type", "pii_text"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    df = queries.queries()[name](spark, D)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows})
    if name == "p6_roundtrip":
        assert rows and all(r.same for r in rows)
