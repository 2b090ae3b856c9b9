"""Small helpers shared by the operators: written tables, column fitting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.session import checkpoint_dir

_CONF = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one is set only where it is unset."""
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if not folder:
        folder = checkpoint_dir(spark)
        spark.conf.set(_CONF, folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not a
    re-run, and several consumers share one computation.  The schema is given
    on the way back, so that an empty table is read as well.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once what was made of them is written as well."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB, unless the session names a size itself.

    A task of long rows then holds a few MB of them, in the JVM and in Python,
    whatever the number of rows that a batch may have.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "4m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    """The text as a string, with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
