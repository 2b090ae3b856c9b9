"""Share-of-shelf reshape: ordered question blocks inside a visit.

Per visit, in row order: a question containing TOTAL (and not UNILEVER SOS)
sets the running total (last one wins, null included); a question containing
UNILEVER SOS closes the block: the block total is the first ``$ <number>`` of
its answer, else the running total, and every pending brand row of the block
is emitted with it; brand rows after the last closing row are dropped.

Spark form: block number = closers strictly before the row (prefix count,
hot-visit safe); block attributes come from one grouped aggregate per
(visit, block); brand rows join their block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import SOS_CLOSE_KEYWORD, SOS_TABLE, SOS_TOTAL_KEYWORD
from ..functions import clean_text, sos_dollar
from .scan import DEFAULT_BUCKET, prefix_count

SOS_COLUMNS = ["visit_id", "task", "response_date", "qst", "qst_value", "total"]


def sos_blocks(tagged: DataFrame, bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    rows = tagged.filter(F.col("target_table") == SOS_TABLE).select(
        "visit_id", "src_ordinal", "responsedate",
        clean_text("question").alias("qst"),
        clean_text("response").alias("qst_value"),
        clean_text("task").alias("task"),
    )
    up = F.upper(F.col("qst"))
    is_close = F.coalesce(up.contains(SOS_CLOSE_KEYWORD), F.lit(False))
    is_total = F.coalesce(up.contains(SOS_TOTAL_KEYWORD), F.lit(False)) & ~is_close
    rows = rows.withColumn("is_close", is_close).withColumn("is_total", is_total)
    rows = prefix_count(rows, ["visit_id"], "src_ordinal", "is_close", "blk", bucket_size)

    has_rd = F.col("responsedate").isNotNull()
    blocks = rows.groupBy("visit_id", "blk").agg(
        F.max(F.col("is_close").cast("int")).alias("closed"),
        F.max_by("qst_value", F.when(F.col("is_close"), F.col("src_ordinal"))).alias("close_value"),
        F.max_by("qst_value", F.when(F.col("is_total"), F.col("src_ordinal"))).alias("running_total"),
        F.min_by("responsedate", F.when(has_rd, F.col("src_ordinal"))).alias("_rd"),
        F.min(F.when(has_rd, F.col("src_ordinal"))).alias("_rd_ord"),
    )
    # response date of the visit = first non-null time over all its rows (one
    # row per block here, so this aggregate is small).
    visit_dates = blocks.groupBy("visit_id").agg(F.min_by("_rd", "_rd_ord").alias("_visit_rd"))
    closed = (blocks.filter(F.col("closed") == 1)
              .withColumn("total", F.coalesce(sos_dollar("close_value"), F.col("running_total")))
              .join(visit_dates, "visit_id")
              .select("visit_id", "blk", "total", F.to_date("_visit_rd").alias("response_date")))
    brands = rows.filter(F.col("qst").isNotNull() & ~F.col("is_close") & ~F.col("is_total"))
    return brands.join(closed, ["visit_id", "blk"], "inner").select(*SOS_COLUMNS)
