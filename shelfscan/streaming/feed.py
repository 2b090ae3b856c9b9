"""Export directory as a stream: every new file batch runs the daily job.

``readStream`` on the export folder (file source, schema given up front) feeds
``foreachBatch``; the batch is prepared like a file export and handed to the
batch pipeline unchanged.  Loads replace by visit, so a re-delivered file is
harmless for the tables; a batch is one request of validation, so that one that
is run again after a crash has one set of findings.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.export import FILE_SLOT, norm_header, prepare_source
from ..sources.store import TableStore
from . import _state
from ..plans import pipeline


def export_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _batch_source(batch: DataFrame) -> DataFrame:
    """Row order inside a micro-batch: file rank (by name) then position in file.

    Text formats: the split's byte offset plus the row number inside the split
    (computed here, on the static micro-batch, straight over the file scan).
    """
    if "_pos" not in batch.columns:
        local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
        batch = batch.withColumn("_pos", F.col("_block") + local).drop("_block")
    files = batch.select("_file").distinct()
    # one row per file of the batch (bounded by maxFilesPerTrigger)
    ranks = files.withColumn("_rank", F.row_number().over(Window.orderBy("_file")) - 1)
    ordered = batch.join(F.broadcast(ranks), "_file")
    ordered = ordered.withColumn("src_ordinal", F.col("_rank") * F.lit(FILE_SLOT) + F.col("_pos"))
    return prepare_source(norm_header(ordered.drop("_file", "_rank", "_pos")))


def start_export_feed(spark: SparkSession, input_dir: str, store_root: str, columns: list[str],
                      fmt: str = "csv", mode: str = pipeline.DAILY, checkpoint: str | None = None,
                      max_files_per_trigger: int = 100, available_now: bool = True) -> StreamingQuery:
    reader = (spark.readStream.format(fmt).schema(export_schema(columns))
              .option("maxFilesPerTrigger", max_files_per_trigger))
    if fmt == "csv":
        reader = reader.option("header", "true")
    stream = reader.load(input_dir)
    pos = (F.col("_metadata.row_index").alias("_pos") if fmt == "parquet"
           else F.col("_metadata.file_block_start").alias("_block"))
    stream = stream.select("*", F.col("_metadata.file_path").alias("_file"), pos)
    feed: list[str] = []
    started = threading.Event()

    def process(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        # A micro-batch belongs to the query's own session.  All work on it is
        # done there: an observation of one session never sees a write of another.
        session = batch.sparkSession
        store = TableStore(session, store_root)
        if _state.batch_done(store, feed[0], batch_id):
            return
        pipeline.run(session, _batch_source(batch), store, mode=mode, batch_id=batch_id, request_id=f"{feed[0]}/{batch_id}")
        _state.mark_done(session, store, feed[0], batch_id)

    # the same folder in every session, so that a restart goes on where it was
    ckpt = checkpoint or f"{store_root.rstrip('/')}/_feeds/{hashlib.sha256(input_dir.rstrip('/').encode()).hexdigest()[:16]}"
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    query = writer.start()
    feed.append(str(query.id))
    started.set()
    return query
