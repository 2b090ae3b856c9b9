"""Ascending order of ids over the cluster, without a single-task sort.

Ids are cut into ranges of about equal counts; every range is one partition,
and partitions are streamed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import partitions


def range_starts(df: DataFrame, id_col: str) -> list[int]:
    """Lower bounds of all ranges but the first: fewer than there are shuffle partitions."""
    n = partitions(df.sparkSession)
    if n < 2:
        return []
    cuts = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 100 * n)).first()[0]
    return sorted(set(cuts or []))


def range_number(id_col: str, starts: list[int]) -> Column:
    """Number of the id's range, from 0, by binary search; null ids are in the first."""
    at = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(at >= F.lit(starts[mid - 1]), search(mid, hi)).otherwise(search(lo, mid - 1))
    return search(0, len(starts))
