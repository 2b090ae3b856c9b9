"""Session helpers.

Cluster settings win: every option here is applied only when the session (or
spark-submit) has not set it already.  Tests and the bench call
``get_session`` on ``local[N]``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults that matter for correctness (UTC wall clock, ANSI casts are handled
# with try_* functions) and for scale (AQE coalescing / skew splitting).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def get_session(master: str | None = None, app: str = "shelfscan",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    active = SparkSession.getActiveSession()
    if active is None:  # spark-submit's settings win over these defaults
        from pyspark import SparkConf
        submitted = SparkConf()
        conf = {k: v for k, v in conf.items() if k in (extra or {}) or not submitted.contains(k)}
        for k, v in conf.items():
            builder = builder.config(k, v)
    spark = active or builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.ui.") or k.startswith("spark.cleaner."):
            continue
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def compile_small(spark: SparkSession) -> None:
    """Have wide projections compiled in methods that the JVM runs as machine code.

    HotSpot interprets methods of over 8,000 bytes, many times slower; Spark's
    own limit lets the methods of a whole stage grow to 65,535.
    """
    if spark.conf.get(METHOD_LIMIT, None) is None:
        spark.conf.set(METHOD_LIMIT, "8000")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables and checkpoints.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system).  Only when it is unset (local tests) a scratch folder is
    created and registered.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(a machine-local folder is not visible to executors)")
        d = tempfile.mkdtemp(prefix="shelfscan-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
