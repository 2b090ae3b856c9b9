"""Summary reports over the base tables and the findings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..constants import GPS_RULE_CODE, LATEST_RESULTS_LIMIT, OSA_NO, OSA_RULE_CODE, OSA_YES
from ..functions import case_banner

DEVIATION_COLUMN = "q_callcycle_deviation"

# Tie-breakers after the report's own order, so "latest N" is deterministic.
_TIE = ["rule_code", "visit_id", "entity_id", "question", "actual_value", "message"]


def deviation_summary(deviation_wide: DataFrame, visits: DataFrame, employees: DataFrame) -> DataFrame:
    """Per employee: 'Non' answers (completed), 'Oui' answers (deviated), all rows; by username."""
    if DEVIATION_COLUMN not in deviation_wide.columns:
        raise ValueError(f"task_callcycle_deviation has no column {DEVIATION_COLUMN}")
    q = F.col(DEVIATION_COLUMN)
    j = (deviation_wide.select("visit_id", DEVIATION_COLUMN)
         .join(visits.select("visit_id", "employee_id"), "visit_id")
         .join(employees.select("employee_id", "employee_code", "username"), "employee_id"))
    return (j.groupBy("employee_id", "employee_code", "username").agg(
                F.sum(F.when(q == OSA_NO, 1).otherwise(0)).cast("bigint").alias("completed_count"),
                F.sum(F.when(q == OSA_YES, 1).otherwise(0)).cast("bigint").alias("deviated_count"),
                F.count(F.lit(1)).cast("bigint").alias("total_count"))
            .orderBy("username"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))
               .select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def issue_count_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_code").agg(F.count(F.lit(1)).cast("bigint").alias("issue_count"))


def issue_count_by_run_rule(findings: DataFrame) -> DataFrame:
    return (findings.groupBy("run_id", "rule_code").agg(F.count(F.lit(1)).cast("bigint").alias("issue_count"))
            .orderBy(F.desc("run_id"), "rule_code"))


def json_banner(details: str = "details_json"):
    return F.get_json_object(F.col(details), "$.banner")


def issue_count_by_banner(findings: DataFrame) -> DataFrame:
    return (findings.filter(F.col("rule_code") == OSA_RULE_CODE)
            .groupBy(json_banner().alias("banner")).agg(F.count(F.lit(1)).cast("bigint").alias("issue_count"))
            .orderBy(F.desc("issue_count"), "banner"))


def _latest_order(df: DataFrame) -> list:
    order = [F.desc("detected_at")] if "detected_at" in df.columns else []
    return order + [F.desc("run_id")] + [F.asc_nulls_first(c) for c in _TIE]


def latest_results(findings: DataFrame, rule_code: str | None = None,
                   n: int = LATEST_RESULTS_LIMIT) -> DataFrame:
    """Newest ``n`` findings (optionally of one rule): a top-k, planned as TakeOrderedAndProject."""
    f = findings if rule_code is None else findings.filter(F.col("rule_code") == rule_code)
    return f.orderBy(*_latest_order(f)).limit(n)


def rule_results_view(findings: DataFrame, n: int | None = LATEST_RESULTS_LIMIT) -> DataFrame:
    """OSA findings with the weekly figures read back from the details JSON."""
    f = findings.filter(F.col("rule_code") == OSA_RULE_CODE)
    d = F.col("details_json")
    out = f.select(
        "run_id", "rule_code", "entity_type", "entity_id", "visit_id", "store_code", "employee_code",
        "product_code", "question", "actual_value", "expected_value", "metric_value", "severity", "message",
        *([c for c in ["detected_at"] if c in f.columns]),
        F.get_json_object(d, "$.banner").alias("banner"),
        F.get_json_object(d, "$.yes_count").cast("bigint").alias("yes_count"),
        F.get_json_object(d, "$.no_count").cast("bigint").alias("no_count"),
        F.get_json_object(d, "$.total_answers").cast("bigint").alias("total_answers"),
        F.get_json_object(d, "$.availability_rate").cast("double").alias("availability_rate"),
    )
    out = out.orderBy(*_latest_order(out))
    return out.limit(n) if n else out


def gps_results_sorted(findings: DataFrame) -> DataFrame:
    f = findings.filter(F.col("rule_code") == GPS_RULE_CODE)
    order = [F.desc("metric_value")] + ([F.desc("detected_at")] if "detected_at" in f.columns else [])
    return f.orderBy(*order, F.desc("run_id"), "visit_id")


def gps_results_report(findings: DataFrame, employees: DataFrame, stores: DataFrame,
                       visits: DataFrame) -> DataFrame:
    """GPS findings with employee / store / visit context; distance sorted numerically."""
    f = findings.filter(F.col("rule_code") == GPS_RULE_CODE)
    dist = F.get_json_object("details_json", "$.distance_meters").cast("decimal(12,2)")
    j = (f.join(employees.select("employee_code", "username"), "employee_code", "left")
          .join(stores.select("store_code", "store_name"), "store_code", "left")
          .join(visits.select("visit_id", "visit_date"), "visit_id", "left"))
    return (j.select("run_id", "rule_code", "severity", "employee_code", "username", "store_code", "store_name",
                     "visit_id", "visit_date", dist.alias("distance_meters"),
                     F.round(dist / 1000, 2).cast("decimal(12,2)").alias("distance_km"),
                     "message")
             .orderBy(F.desc("distance_meters"), "run_id", "visit_id"))


def stores_banner_list(stores: DataFrame) -> DataFrame:
    return stores.select("store_name", case_banner("store_name").alias("banner")).orderBy("store_name")


def run_log_desc(runs: DataFrame) -> DataFrame:
    """Runs of the run log in their latest state (``validation.latest_run_status``), newest first."""
    return runs.select("run_id", "status", "rules_executed", "issues_found").orderBy(F.desc("run_id"))


def rules_by_code(rules: DataFrame) -> DataFrame:
    """Rule metadata in the order of rule codes."""
    return rules.select("rule_code", "rule_name", "description", "source_table", "severity", "is_active").orderBy("rule_code")


def distinct_rule_codes(results: DataFrame) -> DataFrame:
    """Rule codes that occur in findings, with the number of their rows."""
    return results.groupBy("rule_code").agg(F.count(F.lit(1)).cast("bigint").alias("row_count"))


def list_employees(employees: DataFrame, username: str | None = None) -> DataFrame:
    e = employees.select("employee_id", "employee_code", "username")
    return e if username is None else e.filter(F.col("username") == username)
