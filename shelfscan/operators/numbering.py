"""Dense numbers in a given order, without a single-task ranking.

Rows are dealt out in ranges of the order and written with their place in
their range; the few counts per range, added up, give each range its offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

_ROW_BITS = 33  # of monotonically_increasing_id
#: Rows up to which a plain window ranks them: as many as one task sorts with ease.
PLAIN_ROWS = 1 << 20


def dense_numbers(df: DataFrame, group: str, order: str, out: str, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``out``: 1, 2, 3, ... by ``order`` within each value of ``group``.

    ``group`` has few values (one a table).  ``stage`` writes a frame and reads
    it back, so that places and counts come from the same rows.  ``df`` is
    counted, so that it should be read from files.  A frame of few rows is
    ranked by a window, with the same numbers.
    """
    if df.limit(PLAIN_ROWS + 1).count() <= PLAIN_ROWS:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("bigint"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, group, order).sortWithinPartitions(group, order)
    placed = stage(dealt.withColumn("_place", F.monotonically_increasing_id()))
    part: Column = F.shiftright("_place", _ROW_BITS)
    # one row for each range and group: as many as there are partitions and groups
    ranges = placed.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before: dict = {}
    offsets = []
    for r in sorted(ranges.collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], r["_group"], before.get(r["_group"], 0) + 1 - r["_first"]))
        before[r["_group"]] = before.get(r["_group"], 0) + r["_n"]
    table = df.sparkSession.createDataFrame(offsets, f"_part bigint, _group {df.schema[group].dataType.simpleString()}, _shift bigint")
    joined = placed.join(F.broadcast(table), (part == F.col("_part")) & (F.col(group) == F.col("_group")))
    return joined.withColumn(out, F.col("_place") + F.col("_shift")).drop("_place", "_part", "_group", "_shift")
