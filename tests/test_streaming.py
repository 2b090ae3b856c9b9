"""Export folder as a stream: each file batch runs the job; re-delivered batches are skipped."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfscan.plans import catalog, pipeline
from shelfscan.sources import events_source, split_deliveries
from shelfscan.sources.schema import EXPORT_HEADER
from shelfscan.sources.store import TableStore
from shelfscan.streaming import start_export_feed
from test_export import raw_export


def test_feed_two_files(spark, tmp_root):
    src = events_source(spark, SF_SMALL)
    morning, afternoon = split_deliveries(src)
    inbox = f"{tmp_root}/inbox"
    for i, part in enumerate([morning, afternoon]):
        (raw_export(part).coalesce(1).write.mode("overwrite").option("header", "true")
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
            .csv(f"{tmp_root}/tmp{i}"))
        # move the finished file into the watched folder in delivery order
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs.Path(inbox).getFileSystem(conf)
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(inbox))
        st = [x for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{tmp_root}/tmp{i}")) if x.getPath().getName().endswith(".csv")]
        fs.rename(st[0].getPath(), jvm.org.apache.hadoop.fs.Path(f"{inbox}/export_{i}.csv"))
    header = [f" {k.upper()} " for k in EXPORT_HEADER]
    q = start_export_feed(spark, inbox, f"{tmp_root}/store", header, fmt="csv", mode=pipeline.BACKFILL,
                          checkpoint=f"{tmp_root}/ckpt", max_files_per_trigger=1)
    q.awaitTermination(600)
    store = TableStore(spark, f"{tmp_root}/store")
    assert store.read("feed_batches").count() == 2
    exp = catalog.QUERIES["replace_by_visit"](spark, SF_SMALL).filter(F.col("question").isNotNull())
    got = store.read("survey_responses").select(*exp.columns)
    key = lambda r: repr(tuple(r))
    # ids differ from the catalog's (ordinals are file positions here), so compare without ids
    strip = lambda df: sorted((tuple(x) for x in df.drop("visit_id").collect()), key=repr)
    assert strip(got) == strip(exp)
