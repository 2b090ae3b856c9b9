"""Migration of a store's legacy findings to the generic findings schema, as one job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import MIGRATED_STATUS
from ..operators import migrate
from ..sources.schema import FINDINGS_SCHEMA
from ..sources.store import TableStore
from .validation import RESULTS, RESULTS_BY, RULES_SCHEMA, RUN_LOG, RUN_LOG_SCHEMA, _log

BACKUP_PREFIX = "validation_results_legacy_"
CREATED, UNCHANGED = "CREATED", "UNCHANGED"


def run_migration(spark: SparkSession, store: TableStore, now: dt.datetime | None = None) -> dict:
    """Bring ``validation_results`` to the generic schema; a second call changes nothing.

    Without that table the three validation tables are made, empty.  A table
    that has the generic columns is left as it is.  A legacy one keeps its files
    under a backup name; its rows, the rules that it names, and a run with the
    status MIGRATED are published in one version, or none of them is.  Rules
    that are known already keep ``is_active``.
    """
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    legacy = store.read(RESULTS)
    if legacy is not None and migrate.is_already_migrated(legacy.columns):
        return {"status": UNCHANGED}
    with store.transaction():
        if legacy is None:
            detected = spark.createDataFrame([], FINDINGS_SCHEMA).withColumn("detected_at", F.lit(None).cast("timestamp_ntz"))
            store.overwrite(RESULTS, detected, RESULTS_BY)
            for name, schema in (("validation_rules", RULES_SCHEMA), (RUN_LOG, RUN_LOG_SCHEMA)):
                if not store.exists(name):
                    store.overwrite(name, spark.createDataFrame([], schema))
            return {"status": CREATED}
        backup = f"{BACKUP_PREFIX}{now:%Y%m%d_%H%M%S}"
        store.rename(RESULTS, backup)
        log = store.read(RUN_LOG)
        run_id = 1 + (0 if log is None else int(log.agg(F.max("run_id")).first()[0] or 0))
        findings = migrate.migrate_results(legacy, run_id)
        written = store.overwrite(RESULTS, findings, RESULTS_BY)
        rules = store.overwrite("validation_rules", merge_rules(store.read("validation_rules"), migrate.migrated_rule_meta(spark, written), now))
        counts = written.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("rule_code").alias("rules")).first()
        _log(spark, store, run_id, now, now, MIGRATED_STATUS, counts["rules"], counts["rows"],
             f"Legacy validation results migrated from {backup}", None, alone=True)
    return {"status": MIGRATED_STATUS, "run_id": run_id, "backup": backup, "rules": counts["rules"], "rows": counts["rows"], "rules_table": rules}


def merge_rules(old: DataFrame | None, found: DataFrame, now: dt.datetime) -> DataFrame:
    """Rules with the metadata of ``found``; known ones keep their state and their first day."""
    stamp = F.lit(now).cast("timestamp_ntz")
    if old is None:
        return found.select(*[f.name for f in RULES_SCHEMA.fields[:6]], stamp.alias("created_at"), stamp.alias("updated_at"))
    o, n = old.alias("o"), found.withColumn("_here", F.lit(True)).alias("n")
    here = F.col("n._here").isNotNull()
    meta = ["rule_name", "description", "source_table", "severity"]
    return o.join(n, "rule_code", "full_outer").select(
        "rule_code", *[F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in meta],
        F.coalesce(F.col("o.is_active"), F.lit(True)).alias("is_active"),
        F.coalesce(F.col("o.created_at"), stamp).alias("created_at"), F.when(here, stamp).otherwise(F.col("o.updated_at")).alias("updated_at"))
