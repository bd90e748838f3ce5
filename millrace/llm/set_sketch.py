"""Distinct counts from registers on a logarithmic scale.

An identifier picks one of ``m`` registers and a level
``floor(1 - log_b(u))`` from two independent 64-bit hashes; a register keeps
the greatest level.  The base ``b`` sets the resolution: 2 gives coarse small
registers, values near 1 give fine ones, with an error that falls towards
``1 / sqrt(m)``.  Registers of any two partial results merge by maximum, in any
order, as often as one likes, so repeated and late rows change nothing.

Every input split keeps the registers of its groups as arrays and packs them: a
partial result is a row (group, registers, listed).  One exchange brings the rows
of a group together, sorted, and a stream merges them, however many there are:
a hot group costs one packed row a split.  No set is ever held.

Estimates are maximum-likelihood under the Poisson model, in which a register
of a set of ``n`` has ``P(level <= k) = exp(-(n / m) * b**-k)``; this holds from
the empty set upwards.  The estimates of many groups are solved for at once.
Two sketches share their hashes, so the rates of the three parts (only A, both,
only B) are estimated jointly from the pairs of levels, which gives union,
intersection and Jaccard consistently.

Stated errors, as one standard deviation at most: of a count or a union,
``e = stated_error(m, b)`` as a share of it; of an intersection, ``e`` times the
union; of a Jaccard index ``j``, ``e * (1 + j)``.

Defined results
* Null identifiers and null or empty arrays add nothing; a group with no
  identifier at all has the estimate 0.  Null group values are groups.
* Integer identifiers are hashed as 64-bit numbers, others by their hash in Spark.
* An empty table gives no rows; columns not named are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import spread

REGISTERS = 4096
BASE = 1.2
#: Bytes of registers that a split holds before it passes them on, and groups whose estimates are solved for at once.
HELD = 1 << 26
TOGETHER = 256


def stated_error(m: int = REGISTERS, b: float = BASE) -> float:
    """Asymptotic relative standard error of the maximum-likelihood count,
    ``sqrt(ln b / zeta(2, b / (b - 1)) / m)``; smaller sets have less."""
    x, terms = b / (b - 1), 64
    zeta = sum((x + k) ** -2 for k in range(terms)) + 1 / (x + terms) + 0.5 / (x + terms) ** 2
    return math.sqrt(math.log(b) / zeta / m)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kind(b: float) -> type:
    """The narrowest type of a level: none exceeds that of the least 53-bit fraction."""
    return np.uint8 if 53 * math.log(2) / math.log(b) + 1 < 256 else np.uint16


def levels(ids: np.ndarray, m: int = REGISTERS, b: float = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Registers and levels of 64-bit identifiers."""
    x = ids.astype(np.int64).view(np.uint64)
    u = ((_mixed(x, 0x1E7E1) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
    return (_mixed(x, 0x5E7) % np.uint64(m)).astype(np.int64), np.floor(1 - np.log(u) / math.log(b)).astype(_kind(b))


def pack(row: np.ndarray) -> bytes:
    """Registers of one group: all levels, or the touched registers with their levels if that is shorter."""
    at = np.flatnonzero(row)
    wide = row.dtype.itemsize
    if len(at) * (4 + wide) < len(row) * wide:
        return at.astype(np.uint32).tobytes() + row[at].tobytes()
    return row.tobytes()


def unpack(blob: bytes, row: np.ndarray) -> None:
    """Merges packed registers into a row, by maximum."""
    wide = row.dtype.itemsize
    if len(blob) == len(row) * wide:
        np.maximum(row, np.frombuffer(blob, dtype=row.dtype), out=row)
    else:
        n = len(blob) // (4 + wide)
        at = np.frombuffer(blob, dtype=np.uint32, count=n)
        row[at] = np.maximum(row[at], np.frombuffer(blob, dtype=row.dtype, offset=4 * n))


def _named(df: DataFrame, groups: Sequence[str]) -> tuple[list, str]:
    """Group columns as ``g0``... and their types."""
    columns = [F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]
    return columns, "".join(f"g{i} {f.dataType.simpleString()}, " for i, f in enumerate(df.select(*columns).schema.fields))


def _keys(batch: pa.RecordBatch, n: int) -> list[tuple]:
    return list(zip(*[batch.column(i).to_pylist() for i in range(n)])) if n else [()] * batch.num_rows


def _rows(keys: list[tuple], fields: list[pa.Field], rest: list[pa.Array], names: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], f.type) for i, f in enumerate(fields)]
    return pa.RecordBatch.from_arrays([*columns, *rest], names=[*[f.name for f in fields], *names])


def sketch(df: DataFrame, groups: Sequence[str], ids: str, m: int = REGISTERS, b: float = BASE) -> DataFrame:
    """Partial results of an array column of identifiers: ``groups``, ``registers`` (packed), ``listed``
    (identifiers as stored); a group has a row for every split that holds it."""
    columns, types = _named(df, groups)
    element = df.select(F.col(ids).alias("ids")).schema[0].dataType.elementType
    numbers = F.col(ids).cast("array<bigint>") if isinstance(element, T.IntegralType) else F.transform(F.col(ids), lambda x: F.when(x.isNotNull(), F.xxhash64(x)))
    n, kind = len(groups), _kind(b)
    most = max(1, HELD // (m * np.dtype(kind).itemsize))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple, int] = {}
        top, listed = np.zeros((16, m), dtype=kind), np.zeros(16, dtype=np.int64)

        def packed() -> pa.RecordBatch:
            blobs = [pack(top[i]) for i in range(len(places))]
            return _rows(list(places), fields, [pa.array(blobs, pa.binary()), pa.array(listed[: len(places)])], ("registers", "listed"))

        for batch in batches:
            fields = [batch.schema.field(i) for i in range(n)]
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                keys = _keys(part, n)
                if len(places) + len(set(keys) - places.keys()) > most:
                    yield packed()
                    places.clear()
                    top[:], listed[:] = 0, 0
                code = np.array([places.setdefault(k, len(places)) for k in keys], dtype=np.int64)
                if len(places) > len(top):
                    more = max(len(places), 2 * len(top)) - len(top)
                    top, listed = np.concatenate([top, np.zeros((more, m), dtype=kind)]), np.concatenate([listed, np.zeros(more, dtype=np.int64)])
                lists = part.column(n)
                flat, row = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists))
                there = np.asarray(pc.is_valid(flat))
                owner = code[row[there]]
                register, level = levels(np.asarray(flat.drop_null()), m, b)
                np.maximum.at(top.reshape(-1), owner * m + register, level)
                listed += np.bincount(owner, minlength=len(listed))
        if places:
            yield packed()

    out = spread(df.select(*columns, numbers.alias("ids"))).mapInArrow(build, f"{types}registers binary, listed bigint")
    return out.toDF(*groups, "registers", "listed")


def _together(partial: DataFrame, columns: list, *order: str) -> DataFrame:
    """Partial rows of a group in one partition, one after the other."""
    keys = [f"g{i}" for i in range(len(columns))]
    rows = partial.select(*columns, *order, "registers", "listed")
    rows = rows.repartition(*keys) if keys else rows.coalesce(1)
    return rows.sortWithinPartitions(*keys, *order) if keys or order else rows


def _merged(batches: Iterator[pa.RecordBatch], n: int, m: int, b: float) -> Iterator[tuple[list[pa.Field], tuple, np.ndarray, int]]:
    """Fields, key, registers and listed identifiers of every run of rows with one key."""
    fields, last, row, listed = [], None, None, 0
    for batch in batches:
        fields = [batch.schema.field(i) for i in range(n)]
        for key, blob, count in zip(_keys(batch, n), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
            if row is None or key != last:
                if row is not None:
                    yield fields, last, row, listed
                last, row, listed = key, np.zeros(m, dtype=_kind(b)), 0
            unpack(blob, row)
            listed += count
    if row is not None:
        yield fields, last, row, listed


def merge(partial: DataFrame, groups: Sequence[str], m: int = REGISTERS, b: float = BASE) -> DataFrame:
    """Merges partial results onto fewer (or the same) groups by maximum: one row a group."""
    columns, types = _named(partial, groups)
    n = len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for fields, key, row, listed in _merged(batches, n, m, b):
            held.append((key, pack(row), listed))
            if len(held) == TOGETHER:
                yield _rows([h[0] for h in held], fields, [pa.array([h[1] for h in held], pa.binary()), pa.array([h[2] for h in held])], ("registers", "listed"))
                held.clear()
        if held:
            yield _rows([h[0] for h in held], fields, [pa.array([h[1] for h in held], pa.binary()), pa.array([h[2] for h in held])], ("registers", "listed"))

    return _together(partial, columns).mapInArrow(run, f"{types}registers binary, listed bigint").toDF(*groups, "registers", "listed")


def _rates(count: np.ndarray, b: float) -> np.ndarray:
    """Maximum-likelihood identifiers a register, of histograms of levels (a row each; column 0: untouched)."""
    used = np.flatnonzero(count[:, 1:].any(axis=0)) + 1
    if not len(used):
        return np.zeros(len(count))
    base, c, empty = b ** -used.astype(float), count[:, used].astype(float), count[:, 0].astype(float)
    least = empty + c @ base
    low, high = np.full(len(count), math.log(1e-9)), np.full(len(count), math.log(1e3 / base.min()))
    for _ in range(48):  # the score falls with the rate: bisection on a logarithmic scale
        mid = (low + high) / 2
        # P(level = k) = exp(-rate b**-k) (1 - exp(-rate (b - 1) b**-k))
        score = (c * (base * (b - 1)) / np.expm1(np.minimum(np.exp(mid)[:, None] * (base * (b - 1)), 700))).sum(axis=1) - least
        low, high = np.where(score > 0, mid, low), np.where(score > 0, high, mid)
    return np.where(c.any(axis=1), np.exp((low + high) / 2), 0.0)


def estimates(rows: np.ndarray, b: float = BASE) -> np.ndarray:
    """Estimates of many groups, from a row of all register levels each."""
    groups, m = rows.shape
    width = int(rows.max(initial=0)) + 1
    count = np.bincount((rows + np.arange(groups, dtype=np.int64)[:, None] * width).reshape(-1), minlength=groups * width).reshape(groups, width)
    return _rates(count, b) * m


def estimate(values: np.ndarray, m: int = REGISTERS, b: float = BASE) -> float:
    """Estimate from the levels of the touched registers."""
    row = np.zeros((1, m), dtype=np.int64)
    row[0, : len(values)] = values
    return float(estimates(row, b)[0])


def _log_likelihood(i: np.ndarray, j: np.ndarray, count: np.ndarray, b: float):
    """The log-likelihood of three rates, for fixed pairs of levels."""
    corners = []
    for x, y in ((i, j), (i - 1, j), (i, j - 1), (i - 1, j - 1)):
        inside = (x >= 0) & (y >= 0)
        x, y = x.astype(float), y.astype(float)
        corners.append((inside, np.stack([b**-x, b**-y, b ** -np.minimum(x, y)])))

    def value(rates: np.ndarray) -> float:
        p = [np.where(inside, np.exp(-(rates @ power)), 0.0) for inside, power in corners]
        return float((count * np.log(np.maximum(p[0] - p[1] - p[2] + p[3], 1e-300))).sum())

    return value


def joint(a: np.ndarray, c: np.ndarray, m: int = REGISTERS, b: float = BASE) -> tuple[float, float, float, float, float]:
    """Counts of A and B, union, intersection and Jaccard, from dense level arrays of length ``m``."""
    pairs, count = np.unique(np.stack([a, c]).astype(np.int64), axis=1, return_counts=True)
    i, j = pairs
    n_a, n_b, n_u = estimates(np.stack([a, c, np.maximum(a, c)]).astype(np.int64), b) / m
    if not n_a or not n_b:
        n_a, n_b = n_a * m, n_b * m
        return n_a, n_b, n_a + n_b, 0.0, 0.0
    tiny = 1e-6 * max(n_a, n_b) / m
    both = min(max(n_a + n_b - n_u, tiny), min(n_a, n_b))
    rates = np.maximum([n_a - both, n_b - both, both], tiny)
    likelihood = _log_likelihood(i, j, count, b)
    best = likelihood(rates)
    step = 0.1
    while step > 1e-3:  # coordinate ascent; the third pair of moves shifts mass between the parts
        moved = False
        for k, sign in ((0, 1), (0, -1), (1, 1), (1, -1), (2, 1), (2, -1), (3, 1), (3, -1)):
            trial = rates.copy()
            if k < 3:
                trial[k] *= math.exp(sign * step)
            else:
                shift = sign * step * min(rates[2], max(min(rates[0], rates[1]), tiny))
                trial = np.maximum(trial + np.array([-shift, -shift, shift]), tiny)
            value = likelihood(trial)
            if value > best + 1e-9:
                rates, best, moved = trial, value, True
        step = step if moved else step / 2
    only_a, only_b, both = rates * m
    union = only_a + only_b + both
    return only_a + both, only_b + both, union, both, both / union


def distinct_counts(partial: DataFrame, groups: Sequence[str], m: int = REGISTERS, b: float = BASE) -> DataFrame:
    """Per group: ``listed`` (identifiers as stored), ``distinct_ids`` (estimate), ``error`` (stated relative error)."""
    columns, types = _named(partial, groups)
    n = len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, listed = [], np.empty((TOGETHER, m), dtype=_kind(b)), []
        for fields, key, row, count in _merged(batches, n, m, b):
            rows[len(keys)] = row
            keys.append(key)
            listed.append(count)
            if len(keys) == TOGETHER:
                yield _rows(keys, fields, [pa.array(listed), pa.array(estimates(rows, b))], ("listed", "distinct_ids"))
                keys, listed = [], []
        if keys:
            yield _rows(keys, fields, [pa.array(listed), pa.array(estimates(rows[: len(keys)], b))], ("listed", "distinct_ids"))

    out = _together(partial, columns).mapInArrow(run, f"{types}listed bigint, distinct_ids double")
    return out.toDF(*groups, "listed", "distinct_ids").withColumn("error", F.lit(stated_error(m, b)))


def overlaps(left: DataFrame, right: DataFrame, groups: Sequence[str], m: int = REGISTERS, b: float = BASE) -> DataFrame:
    """Joint estimates of the groups that stand in both partial results (null group values match), each with its stated error."""
    both = left.select(*groups, F.lit(0).alias("side"), "registers", "listed").unionByName(right.select(*groups, F.lit(1).alias("side"), "registers", "listed"))
    columns, types = _named(both, groups)
    n = len(groups)
    names = ("a_ids", "b_ids", "union_ids", "both_ids", "jaccard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[tuple, np.ndarray] | None = None
        for fields, key, row, _ in _merged(batches, n + 1, m, b):
            if key[-1] == 0:
                before = key[:-1], row
            elif before is not None and before[0] == key[:-1]:
                yield _rows([key[:-1]], fields[:-1], [pa.array([x]) for x in joint(before[1].astype(np.int64), row.astype(np.int64), m, b)], names)

    out = _together(both, columns, "side").mapInArrow(run, types + ", ".join(f"{x} double" for x in names)).toDF(*groups, *names)
    e = F.lit(stated_error(m, b))
    return out.select("*", e.alias("union_error"), (e * F.col("union_ids")).alias("both_error"), (e * (1 + F.col("jaccard"))).alias("jaccard_error"))


def repeated_cells(df: DataFrame, groups: Sequence[str], ids: str, m: int = REGISTERS, b: float = BASE) -> DataFrame:
    """Groups of which, by the estimate, at most half of the listed identifiers differ.

    A group within the stated error of one half may fall on either side.
    """
    counted = distinct_counts(sketch(df, groups, ids, m, b), groups, m, b)
    return counted.filter((F.col("listed") > 0) & (F.col("distinct_ids") <= 0.5 * F.col("listed")))
