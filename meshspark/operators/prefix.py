"""Running sums and row numbers over a total order, without sending all rows to one task.

Rows fall into ranges of the whole order; cut points are quantiles of a sample of order keys
(SAMPLE * `ranges` keys on the driver at most).  Inside a range an ordinary window runs; one row of
totals per range gives what stands before it.  Only rows equal in all order columns must share a range.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 20


def _cuts(df: DataFrame, order: list[str], directed: list[Column], ranges: int) -> list[tuple]:
    """Rising order keys that cut df into about `ranges` even parts; any choice gives right sums."""
    picked = df.select(*order).orderBy(F.rand(1)).limit(SAMPLE * ranges)
    keys = [tuple(r) for r in picked.orderBy(*directed).collect()]
    at = sorted({len(keys) * i // ranges for i in range(1, ranges)})
    return [k for k, _ in groupby(keys[i] for i in at if i < len(keys))]


def _place(after: list[Column], low: int, high: int) -> Column:
    """How many of the cuts low .. high - 1 a row is behind, plus low: a binary search."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(after[mid], _place(after, mid + 1, high)).otherwise(_place(after, low, mid))


def running(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, number: str | None = None, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """df with inclusive running sums (name -> column) and row numbers from 1.

    `descending` turns the first order column around; the others rise.
    """
    sums = dict(sums or {})
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    directed = [F.desc(order[0]) if descending else F.asc(order[0]), *map(F.asc, order[1:])]
    kinds = {c: df.schema[c].dataType for c in order}

    def behind(key: tuple) -> Column:
        """The row stands behind the key (structs compare field by field, nulls first)."""
        of = lambda names: F.struct(*(F.col(c).alias(c) for c in names))
        cut = lambda names: F.struct(*(F.lit(key[order.index(c)]).cast(kinds[c]).alias(c) for c in names))
        if not descending:
            return of(order) > cut(order)
        first, rest = order[:1], order[1:]
        turned = of(first) < cut(first)
        return turned | ((of(first) == cut(first)) & (of(rest) > cut(rest))) if rest else turned

    after = [behind(k) for k in _cuts(df, order, directed, ranges)]
    ranged = df.withColumn("_range", _place(after, 0, len(after))).withColumn("_one", F.lit(1).cast("long"))
    if number:
        sums[number] = "_one"
    within = W.partitionBy("_range").orderBy(*directed).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    bases = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    out = ranged.withColumns({f"_w_{n}": F.sum(c).over(within) for n, c in sums.items()}).join(F.broadcast(bases), "_range")
    return out.select(*df.columns, *((F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))
