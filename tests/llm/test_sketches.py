"""Distinct counts and frequent items against exact answers."""

import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import frequent as mg
from millrace.llm import set_sketch as ss

SCHEMA = "day date, key string, ids array<bigint>, register int, level int"


def stats(spark, rows):
    return spark.createDataFrame([(None, k, ids, 1, 2) for k, ids in rows], SCHEMA)


def test_counts_are_within_the_stated_error(spark):
    rng = random.Random(1)
    pools = {"a": 30, "b": 3000, "c": 60_000, None: 500, "": 7}
    rows = []
    for key, size in pools.items():
        ids = [rng.getrandbits(62) for _ in range(size)]
        rows += [(key, ids[i : i + 5000]) for i in range(0, size, 5000)] + [(key, ids[: size // 2])]
    rows += [("none", None), ("none", []), ("none", [None])]
    df = stats(spark, rows)
    got = {r.key: r for r in ss.distinct_counts(ss.sketch(df, ["key"], "ids"), ["key"]).collect()}
    assert got["none"].distinct_ids == 0 and got["none"].listed == 0
    for key, size in pools.items():
        assert abs(got[key].distinct_ids / size - 1) < 4 * ss.stated_error() + 0.5 / size, key
        assert got[key].listed == size + size // 2


@pytest.mark.parametrize("b", [1.05, 1.2, 2.0])
def test_error_holds_for_any_base(b):
    rng = np.random.default_rng(5)
    m, n, errors = 256, 5000, []
    for _ in range(60):
        register = rng.integers(0, m, n)
        level = np.floor(1 - np.log(rng.random(n)) / np.log(b)).astype(int)
        top = np.zeros(m, dtype=int)
        np.maximum.at(top, register, level)
        errors.append(ss.estimate(top[top > 0], m, b) / n - 1)
    assert np.std(errors) < 1.3 * ss.stated_error(m, b) and abs(np.mean(errors)) < ss.stated_error(m, b)


def test_merge_is_idempotent(spark):
    df = stats(spark, [("a", list(range(i, i + 50))) for i in range(0, 400, 10)])
    one = ss.sketch(df, ["key"], "ids")
    twice = one.unionByName(ss.sketch(df.limit(5), ["key"], "ids"))
    pick = lambda p: {r.key: r.distinct_ids for r in ss.distinct_counts(p, ["key"]).collect()}
    assert pick(one) == pick(twice)


def test_joint_estimates(spark):
    a, b = list(range(0, 20_000)), list(range(15_000, 30_000))
    left, right = ss.sketch(stats(spark, [("k", a), ("l", [1])]), ["key"], "ids"), ss.sketch(stats(spark, [("k", b)]), ["key"], "ids")
    (r,) = ss.overlaps(left, right, ["key"]).collect()
    tolerance = 5 * ss.stated_error() * 30_000
    assert abs(r.union_ids - 30_000) < tolerance and abs(r.both_ids - 5_000) < tolerance and abs(r.jaccard - 1 / 6) < 0.08


def test_repeated_cells(spark):
    df = stats(spark, [("half", [1, 2, 3])] * 2 + [("new", [4, 5])] + [("new", [6])] + [("often", [7])] * 9)
    assert sorted(r.key for r in ss.repeated_cells(df, ["key"], "ids").filter("key <> 'half'").collect()) == ["often"]
    assert ss.repeated_cells(df.filter("key = 'x'"), ["key"], "ids").count() == 0


def test_summary_keeps_its_promise():
    rng = random.Random(2)
    items = [f"i{int(rng.paretovariate(0.6))}" for _ in range(60_000)]
    truth, parts = Counter(items), []
    for start in range(0, len(items), 6000):
        s = mg.Summary(50)
        for x in range(start, start + 6000, 500):
            c = Counter(items[x : x + 500])
            s.add(list(c), list(c.values()))
        parts.append(s)
    whole = mg.Summary(50)
    for s in parts:
        whole.add(list(s.counter), list(s.counter.values()), s.slack, s.total)
    assert whole.total == len(items) and len(whole.counter) <= 50 and whole.slack <= len(items) / 51
    for item, n in truth.items():
        assert whole.counter.get(item, 0) <= n <= whole.counter.get(item, 0) + whole.slack


def test_frequent_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 30 + ["", None, "warm", "warm"] + [f"c{i}" for i in range(200)]), rng.choice([1, 2, None, 0]), 9) for _ in range(5000)]
    df = spark.createDataFrame(rows, "item string, w bigint, weight int").repartition(5)
    for weight in (None, "w"):
        truth = Counter()
        for item, w, _ in rows:
            if item and (weight is None or (w or 0) > 0):
                truth[item] += 1 if weight is None else w
        total = sum(truth.values())
        got = {r["item"]: r["weight"] for r in mg.frequent(df, "item", weight, 0.01, k=300).collect()}
        assert got == {i: n for i, n in truth.items() if n >= 0.01 * total}
    assert mg.frequent(df.filter("false"), "item", None, 0.01).count() == 0
    with pytest.raises(ValueError):
        mg.frequent(df, "item", None, 0.001, k=100)


def test_ties_at_the_threshold(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("b",)], "item string")
    assert sorted(r["item"] for r in mg.frequent(df, "item", None, 0.5).collect()) == ["a", "b"]
