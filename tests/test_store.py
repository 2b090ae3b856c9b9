"""Table store edge cases and the partition-balancing rule."""

from pyspark.sql import functions as F

from shelfscan.sources.export import balance_partitions
from shelfscan.sources.store import TableStore, replace_by_visit


def test_touched_month_emptied_when_no_rows_remain(spark, tmp_root):
    store = TableStore(spark, tmp_root)
    old = spark.createDataFrame([(1, "2024-01", "a"), (2, "2024-02", "b"), (3, "2024-02", "c")],
                                "visit_id bigint, visit_month string, v string")
    store.overwrite("t", old, ["visit_month"])
    # visit 1 is re-delivered with no rows for this table; visit 3 gets a new row
    affected = spark.createDataFrame([(1, "2024-01"), (3, "2024-02")], "visit_id bigint, visit_month string")
    new = spark.createDataFrame([(3, "2024-02", "c2")], "visit_id bigint, visit_month string, v string")
    rows = replace_by_visit(store.read("t"), new, affected)
    store.replace_partitions("t", rows, touched=affected.select("visit_month"))
    got = sorted((r.visit_id, r.visit_month, r.v) for r in store.read("t").collect())
    assert got == [(2, "2024-02", "b"), (3, "2024-02", "c2")]


def test_balance_partitions_only_when_under_split(spark):
    target = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert balance_partitions(one).rdd.getNumPartitions() == target
    many = spark.range(100).repartition(target * 2)
    assert balance_partitions(many) is many
