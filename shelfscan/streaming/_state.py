"""Processed-batch ledger of the feeds into a store (append-only table in it).

A feed is named by its query id, which its checkpoint keeps: batch numbers
count from 0 in every checkpoint.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession, functions as F

from ..sources.store import TableStore

LEDGER = "feed_batches"
SCHEMA = "feed string, batch_id bigint, done_at timestamp_ntz"


def batch_done(store: TableStore, feed: str, batch_id: int) -> bool:
    done = store.read(LEDGER, schema=SCHEMA)
    return done is not None and not done.filter((F.col("feed") == feed) & (F.col("batch_id") == batch_id)).isEmpty()


def mark_done(spark: SparkSession, store: TableStore, feed: str, batch_id: int) -> None:
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    store.append(LEDGER, spark.createDataFrame([(feed, batch_id, now)], SCHEMA))
