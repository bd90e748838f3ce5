"""Most frequent items in bounded memory.

Every split keeps a decrement summary of at most ``k`` counters: counts of an
Arrow batch are added, and while more than ``k`` items have a counter the
``k+1``-th largest counter is subtracted from all and what is not positive
goes.  Two summaries merge the same way: add, then subtract the next-largest
counter.  What is subtracted is summed as ``slack``, so for every item
``estimate <= true weight <= estimate + slack`` and ``slack <= N / (k + 1)``
with ``N`` the whole weight: an item above that share cannot be missing.

Merging is a tree of two levels over at most ``FAN`` groups, so no task reads
more than ``(splits / FAN + FAN) * k`` counters, whatever the data.

Defined results
* Null and empty items take no part, neither do null weights or weights below
  one; the total weight counts the same rows.
* Repeated rows count.  Items are compared byte for byte.
* Ties at the threshold are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

COUNTERS = 2000
FAN = 128
_SCHEMA = "part int, item string, weight bigint, slack bigint, total bigint"


class Summary:
    """Counters of at most ``k`` items."""

    def __init__(self, k: int) -> None:
        self.k, self.slack, self.total = k, 0, 0
        self.counter: dict[str, int] = {}

    def add(self, items: list[str], weights: list[int], slack: int = 0, total: int | None = None) -> None:
        counter = self.counter
        for item, w in zip(items, weights):
            counter[item] = counter.get(item, 0) + w
        self.slack += slack
        self.total += sum(weights) if total is None else total
        if len(counter) > self.k:
            values = np.fromiter(counter.values(), dtype=np.int64, count=len(counter))
            cut = int(np.partition(values, len(values) - self.k - 1)[len(values) - self.k - 1])  # the k+1-th largest
            self.counter = {i: c - cut for i, c in counter.items() if c > cut}
            self.slack += cut

    def frame(self, part: int) -> pd.DataFrame:
        """The counters, and a last row without item for slack and total."""
        n = len(self.counter)
        return pd.DataFrame(
            {
                "part": np.full(n + 1, part, dtype=np.int32),
                "item": [*self.counter, None],
                "weight": np.array([*self.counter.values(), 0], dtype=np.int64),
                "slack": np.array([0] * n + [self.slack], dtype=np.int64),
                "total": np.array([0] * n + [self.total], dtype=np.int64),
            }
        )


def summarise(df: DataFrame, item: Column, weight: Column | None = None, k: int = COUNTERS) -> DataFrame:
    """The merged summary: ``item``, ``estimate``, ``slack``, ``total``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        summary, part = Summary(k), TaskContext.get().partitionId()
        for batch in batches:
            grouped = pa.table([batch.column(0), batch.column(1)], names=["i", "w"]).group_by("i").aggregate([("w", "sum")])
            summary.add(grouped.column("i").to_pylist(), grouped.column("w_sum").to_pylist())
        if summary.total:
            yield pa.RecordBatch.from_pandas(summary.frame(part % FAN), preserve_index=False, schema=arrow)

    arrow = pa.schema([("part", pa.int32()), ("item", pa.string()), ("weight", pa.int64()), ("slack", pa.int64()), ("total", pa.int64())])

    def merged(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        # rows of several summaries may be added one after the other: the cut is taken over all of them
        summary = Summary(k)
        named = parts["item"].notna()
        sums = parts[named].groupby("item", sort=False)["weight"].sum()
        summary.add(sums.index.tolist(), [int(x) for x in sums], int(parts["slack"].sum()), int(parts["total"].sum()))
        return summary.frame(0)

    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    rows = df.select(item.cast("string").alias("i"), weight.alias("w")).filter((F.col("i") != "") & (F.col("w") > 0))
    parts = spread(rows).mapInArrow(local, _SCHEMA)
    tree = parts.groupBy("part").applyInPandas(merged, _SCHEMA).groupBy("part").applyInPandas(merged, _SCHEMA)
    whole = tree.agg(F.max("slack").alias("slack"), F.max("total").alias("total"), F.collect_list(F.when(F.col("item").isNotNull(), F.struct("item", "weight"))).alias("c"))
    return whole.select(F.explode("c").alias("c"), "slack", "total").select("c.item", F.col("c.weight").alias("estimate"), "slack", "total")


def frequent(df: DataFrame, item: str, weight: str | None, share: float, k: int = COUNTERS) -> DataFrame:
    """All items with at least ``share`` of the weight: ``item``, ``estimate``, ``slack``, ``weight`` (exact).

    The summary names every candidate (at most ``1 / (share - 1 / (k + 1))`` of
    them, which is what bounds the broadcast); a second pass counts those.
    """
    if share * (k + 1) <= 1:
        raise ValueError("k is too small for this share")
    w = None if weight is None else F.col(weight)
    found = summarise(df, F.col(item), w, k).filter(F.col("estimate") + F.col("slack") >= F.col("total") * F.lit(share))
    each = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.select(F.col(item).cast("string").alias("item"), each.alias("w")).filter((F.col("item") != "") & (F.col("w") > 0))
    exact = rows.join(F.broadcast(found), "item").groupBy("item", "estimate", "slack", "total").agg(F.sum("w").alias("weight"))
    return exact.filter(F.col("weight") >= F.col("total") * F.lit(share)).select("item", "estimate", "slack", "weight")
