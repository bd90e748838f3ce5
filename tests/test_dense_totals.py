"""Per-key totals against brute force."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from millrace.operators import dense_totals as op

SCHEMA = "key string, n bigint, url string, k string, v string, t bigint"


def brute(rows):
    out = defaultdict(lambda: [0, None, None])
    for key, n, url, *_ in rows:
        o = out[key]
        o[0] += 1
        if n is not None:
            o[1] = (o[1] or 0) + n
        if url is not None and (o[2] is None or url.encode() < o[2].encode()):
            o[2] = url
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r[0]: tuple(r)[1:] for r in op.dense_totals(df, "key", "n", "url").collect()}


def test_skewed_random(spark):
    rng = random.Random(3)
    keys = ["hot"] * 50 + ["", None, "é", "e", "\U0001f600", "￿"] + [f"k{i}" for i in range(40)]
    rows = [(rng.choice(keys), rng.choice([None, -5, 0, 7, 1 << 40, -(1 << 41)]), rng.choice([None, "", "a", "b", "é", "￿", "\U0001f600"]), "x", "y", 1) for _ in range(4000)]
    assert run(spark, rows) == brute(rows)


def test_large_sums_and_long_texts(spark):
    rows = [("k", (1 << 62), "z" * 100_000, None, None, None), ("k", (1 << 62) - 1, "y" * 100_000, None, None, None)]
    assert run(spark, rows) == brute(rows)


def test_all_null_and_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None, None, None, None, None)] * 3) == {None: (3, None, None)}


def test_overflow_raises(spark):
    with pytest.raises(Exception, match="(?i)out of range|overflow"):
        run(spark, [("k", (1 << 63) - 1, None, None, None, None)] * 2)


def test_block_flush(monkeypatch):
    monkeypatch.setattr(op, "BLOCK_KEYS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcab")), pa.array([1, 2, 3, 4, 5]), pa.array(["u", None, "w", "t", "s"])], names=["k", "v", "t"])
    blocks = list(op._accumulate(iter([batch, batch])))
    assert [b.num_rows for b in blocks] == [3, 3]
    whole = pa.Table.from_batches(blocks).sort_by("k")
    merged = pa.Table.from_batches(list(op._reduce(iter(whole.to_batches(max_chunksize=2))))).to_pydict()
    assert merged["k"] == ["a", "b", "c"] and merged["lo"] == [10, 14, 6] and merged["least"] == ["t", "s", "w"]


def test_heavy_keys(spark):
    rows = [("a", 1, None, None, None, None)] * 2 + [("b", 1, None, None, None, None)] + [(None, 1, None, None, None, None)] * 50 + [("", 1, None, None, None, None)] * 47
    assert [r.key for r in op.heavy_keys(spark.createDataFrame(rows, SCHEMA), "key", "n", "url", 2).collect()] == ["a"]
