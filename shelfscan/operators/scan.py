"""Ordered prefix counts per group, safe for hot groups.

``count of flagged rows before this row`` inside a group, in ``order_col``
order, is a running sum.  A plain window partitioned by the group would put
one hot group (say a third of all rows) into a single task.  Here the group is
cut into ordinal buckets: the running sum runs per (group, bucket), bucket
totals are prefix-summed over the (few) buckets of the group, and the two
parts are added.  No task ever holds more than one bucket of one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DEFAULT_BUCKET = 1 << 20


def prefix_count(df: DataFrame, group_cols: list[str], order_col: str, flag_col: str,
                 out_col: str, bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """Add ``out_col`` = number of rows with ``flag_col`` true strictly before each row."""
    flag = F.col(flag_col).cast("int")
    bkt = F.floor(F.col(order_col) / F.lit(bucket_size)).cast("bigint")
    df = df.withColumn("_bkt", bkt)
    w_local = (Window.partitionBy(*group_cols, "_bkt").orderBy(order_col)
               .rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_local", F.coalesce(F.sum(flag).over(w_local), F.lit(0)))
    # totals from the windowed rows: already clustered by (group, bucket), and
    # every branch below goes through the window's exchange, which Spark reuses
    # (the input is read once)
    totals = df.groupBy(*group_cols, "_bkt").agg(F.sum(flag).alias("_n"))
    w_off = Window.partitionBy(*group_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n")
    out = df.join(offsets, [*group_cols, "_bkt"], "inner")
    return out.withColumn(out_col, (F.col("_off") + F.col("_local")).cast("bigint")).drop("_bkt", "_local", "_off")
