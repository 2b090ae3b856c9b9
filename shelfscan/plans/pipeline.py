"""Daily / backfill run of one export: ETL, then (daily only) scoped validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.export import scan_export
from ..sources.store import TableStore
from .etl import run_etl
from .validation import run_validation

DAILY = "daily"
BACKFILL = "backfill"


def run(spark: SparkSession, source: DataFrame, store: TableStore, mode: str = DAILY,
        full_refresh: bool = False, batch_id: int | None = None, request_id: str | None = None) -> dict:
    """Load a prepared delivery; validate the delivered visits when ``mode`` is daily.

    ``request_id`` names the delivery: run again, it has one validation run.

    Validation is skipped for backfills, and when the delivery produced no
    survey rows (nothing new to check).
    """
    if mode not in (DAILY, BACKFILL):
        raise ValueError(f"mode must be {DAILY!r} or {BACKFILL!r}")
    etl = run_etl(spark, source, store, full_refresh=full_refresh)
    out = {"etl": etl["counts"], "delivered": etl["delivered"], "validation": None}
    if mode == DAILY and etl["delivered"]["survey_responses"]:
        out["validation"] = run_validation(spark, store, target=etl["affected"], batch_id=batch_id,
                                           request_id=request_id)
    return out


def run_export(spark: SparkSession, path: str, store_root: str, fmt: str = "csv", mode: str = DAILY,
               full_refresh: bool = False, options: dict | None = None) -> dict:
    """Entry point for a scheduler: export path in, tables under ``store_root``."""
    return run(spark, scan_export(spark, path, fmt, options), TableStore(spark, store_root), mode, full_refresh)
