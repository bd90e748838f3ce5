"""Per-key totals that no hot key can unbalance.

Every input split dictionary-encodes its keys and adds its rows into dense
arrays indexed by the code (``numpy.bincount`` for the numbers, a
scatter-reduce for the least string).  A split sends one array block, in which
a key stands once, however many rows it has there.  The blocks are then
exchanged by key hash, sorted, and summed as arrays, run by run, in a stream:
the reduction holds one Arrow batch, never a group.  A key that owns a third
of the table costs the reduction as many entries as there are splits.

Defined results
* A null key and an empty key are keys of their own.
* ``rows`` counts rows as stored; repeated rows count.
* ``total`` is the exact sum over non-null values, null if there are none; a
  sum beyond 64 bits raises.
* ``least`` is the bytewise least non-null string, null if there is none.
* An empty table gives no rows.  Other columns of the table are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

#: Distinct keys that a split holds before it sends its block and starts anew.
BLOCK_KEYS = 1 << 18

_LOW = np.int64((1 << 32) - 1)
_BLOCK = "k string, n bigint, vals bigint, hi bigint, lo bigint, least string"
_ARROW = pa.schema(
    [("k", pa.string()), ("n", pa.int64()), ("vals", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("least", pa.string())]
)


def _least(codes: np.ndarray, size: int, text: pa.Array) -> np.ndarray:
    """Scatter-reduce: the least text of each code, None where it has none."""
    out = np.full(size, None, dtype=object)
    present = np.flatnonzero(np.asarray(text.is_valid()))
    if not len(present):
        return out
    # order by text first, then stably by code: the first of each run is the least
    words = text.take(pa.array(present)).cast(pa.binary())
    order = np.asarray(pc.sort_indices(words))
    code = codes[present][order]
    first = np.full(size, -1, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]  # the last write of a code wins: its smallest rank
    have = np.flatnonzero(first >= 0)
    out[have] = words.take(pa.array(order[first[have]])).cast(pa.string()).to_numpy(zero_copy_only=False)
    return out


class _Accumulator:
    """Dense arrays of one split, indexed by the split's own dictionary."""

    def __init__(self) -> None:
        self.code: dict[str | None, int] = {}
        self.sums = np.zeros((4, 1024), dtype=np.int64)  # rows, non-null values, high and low half of the sum
        self.least: list[str | None] = []

    def add(self, batch: pa.RecordBatch) -> None:
        encoded = batch.column(0).dictionary_encode(null_encoding="encode")
        words = encoded.dictionary.to_pylist()
        local = np.asarray(encoded.indices)
        code = self.code
        at = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=len(words))
        if len(code) > self.sums.shape[1]:
            grown = np.zeros((4, 2 * len(code)), dtype=np.int64)
            grown[:, : self.sums.shape[1]] = self.sums
            self.sums = grown
        self.least.extend([None] * (len(code) - len(self.least)))
        size = len(words)
        value = batch.column(1)
        valid = np.asarray(value.is_valid())
        v = np.asarray(value.fill_null(0)).astype(np.int64)
        # halves of 32 bits stay exact in bincount's doubles for the 2**21 rows a batch may have at most
        self.sums[0, at] += np.bincount(local, minlength=size)
        self.sums[1, at] += np.bincount(local, weights=valid, minlength=size).astype(np.int64)
        self.sums[2, at] += np.bincount(local, weights=v >> 32, minlength=size).astype(np.int64)
        self.sums[3, at] += np.bincount(local, weights=v & _LOW, minlength=size).astype(np.int64)
        for i, text in zip(at.tolist(), _least(local, size, batch.column(2)).tolist()):
            if text is not None and (self.least[i] is None or text.encode() < self.least[i].encode()):
                self.least[i] = text

    def block(self) -> pa.RecordBatch:
        n = len(self.code)
        hi, lo = self.sums[2, :n], self.sums[3, :n]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(self.code), pa.string()),
                pa.array(self.sums[0, :n]),
                pa.array(self.sums[1, :n]),
                pa.array(hi + (lo >> 32)),
                pa.array(lo & _LOW),
                pa.array(self.least, pa.string()),
            ],
            schema=_ARROW,
        )


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc = _Accumulator()
    for batch in batches:
        for start in range(0, batch.num_rows, 1 << 20):
            acc.add(batch.slice(start, 1 << 20))
            if len(acc.code) >= BLOCK_KEYS:
                yield acc.block()
                acc = _Accumulator()
    if acc.code:
        yield acc.block()


def _fold(table: pa.Table) -> pa.Table:
    """Sums the runs of equal keys of a sorted table."""
    n = table.num_rows
    keys = table.column("k").combine_chunks()
    filled, null = keys.fill_null(""), np.asarray(keys.is_null())
    new = np.ones(n, dtype=bool)
    new[1:] = np.asarray(pc.not_equal(filled[1:], filled[:-1])) | (null[1:] != null[:-1])
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    sums = {c: np.add.reduceat(np.asarray(table.column(c)), starts) for c in ("n", "vals", "hi", "lo")}
    sums["hi"] = sums["hi"] + (sums["lo"] >> 32)
    sums["lo"] = sums["lo"] & _LOW
    least = _least(run, len(starts), table.column("least").combine_chunks())
    return pa.table(
        [keys.take(pa.array(starts)), *(pa.array(sums[c]) for c in ("n", "vals", "hi", "lo")), pa.array(least.tolist(), pa.string())],
        schema=_ARROW,
    )


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Array sum of sorted blocks; the last run stays open for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = pa.Table.from_batches([batch]).cast(_ARROW)
        folded = _fold(pa.concat_tables([rest, block]) if rest is not None else block)
        rest = folded.slice(folded.num_rows - 1)
        yield from folded.slice(0, folded.num_rows - 1).to_batches()
    if rest is not None:
        yield from rest.to_batches()


def dense_totals(df: DataFrame, key: str, value: str, text: str) -> DataFrame:
    """One row per ``key``: ``key``, ``rows``, ``total`` of ``value``, ``least`` of ``text``."""
    split = spread(df.select(F.col(key).cast("string").alias("k"), F.col(value).cast("bigint").alias("v"), F.col(text).cast("string").alias("t")))
    blocks = split.mapInArrow(_accumulate, _BLOCK)
    # the null key's hash differs from that of any string only by chance, so nullness takes part in it
    parts = blocks.repartition(F.col("k"), F.col("k").isNull()).sortWithinPartitions(F.col("k").asc_nulls_first())
    summed = parts.mapInArrow(_reduce, _BLOCK)
    exact = (F.col("hi").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(20,0)") + F.col("lo")).cast("bigint")
    return summed.select(
        F.col("k").alias("key"),
        F.col("n").alias("rows"),
        F.when(F.col("vals") > 0, exact).alias("total"),
        F.col("least"),
    )


def heavy_keys(df: DataFrame, key: str, value: str, text: str, percent: int) -> DataFrame:
    """Keys, neither null nor empty, with at least ``percent`` % of all rows as stored."""
    per_key = dense_totals(df, key, value, text)
    all_rows = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return per_key.filter((F.col("key") != "") & (F.col("rows") * 100 >= all_rows * percent)).select("key", "rows", "total", "least")
