"""Rule contract, registry, rule metadata sync and validation runs with a run log."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import constants as C
from ..operators import rules
from ..sources.store import MONTH_COL, PublishConflict, TableStore

RULES_SCHEMA = T.StructType([
    T.StructField("rule_code", T.StringType()), T.StructField("rule_name", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("source_table", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("is_active", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType()),
])
RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("logged_at", T.TimestampNTZType()),
    T.StructField("started_at", T.TimestampNTZType()), T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()), T.StructField("rules_executed", T.IntegerType()),
    T.StructField("issues_found", T.LongType()), T.StructField("error_message", T.StringType()),
    T.StructField("batch_id", T.LongType()), T.StructField("request_id", T.StringType()),
])
RESULTS, RUN_LOG = "validation_results", "validation_run_log"
#: Findings lie by run and rule, so that a repeated run replaces its own and no others.
RESULTS_BY = ["run_id", "rule_code"]


@dataclass(frozen=True)
class Rule:
    """A data-quality rule: metadata + ``evaluate(tables, target) -> findings``.

    ``tables`` maps table names to DataFrames; ``target`` is None (full
    history) or a DataFrame of ``visit_id`` limiting the findings.
    """
    code: str
    name: str
    description: str
    source_table: str
    severity: str
    evaluate: Callable[[dict, DataFrame | None], DataFrame]


def _osa(tables: dict, target: DataFrame | None) -> DataFrame:
    return rules.osa_findings(rules.osa_unusual_non(tables["survey_responses"], tables["stores"], target))


def _gps(tables: dict, target: DataFrame | None) -> DataFrame:
    gps = rules.visit_gps(tables["visits"], tables["employees"], tables["stores"])
    return rules.gps_findings(rules.gps_inconsistent(gps, target))


OSA_RULE = Rule(C.OSA_RULE_CODE, C.OSA_RULE_NAME, C.OSA_RULE_DESCRIPTION, C.OSA_SOURCE_TABLE, C.OSA_SEVERITY, _osa)
GPS_RULE = Rule(C.GPS_RULE_CODE, C.GPS_RULE_NAME, C.GPS_RULE_DESCRIPTION, C.GPS_SOURCE_TABLE, C.GPS_SEVERITY, _gps)
REGISTERED_RULES: list[Rule] = [OSA_RULE, GPS_RULE]


def registry_frame(spark: SparkSession, registry: list[Rule] = REGISTERED_RULES) -> DataFrame:
    return spark.createDataFrame([(r.code, r.name, r.description, r.source_table, r.severity) for r in registry],
                                 "rule_code string, rule_name string, description string, source_table string, severity string")


def sync_rules(spark: SparkSession, old: DataFrame | None, now: dt.datetime,
               registry: list[Rule] = REGISTERED_RULES) -> DataFrame:
    """Upsert rule metadata; a rule switched off stays off (``is_active`` kept)."""
    reg = registry_frame(spark, registry)
    ts = F.lit(now).cast("timestamp_ntz")
    if old is None:
        return reg.select("*", F.lit(True).alias("is_active"), ts.alias("created_at"), ts.alias("updated_at"))
    o = old.alias("o")
    j = reg.alias("n").join(o, "rule_code", "full_outer")
    reg_cols = ["rule_name", "description", "source_table", "severity"]
    in_reg = F.col("n.rule_name").isNotNull()
    return j.select(
        "rule_code",
        *[F.when(in_reg, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in reg_cols],
        F.coalesce(F.col("o.is_active"), F.lit(True)).alias("is_active"),
        F.coalesce(F.col("o.created_at"), ts).alias("created_at"),
        F.when(in_reg, ts).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def active_rules(rules_table: DataFrame, registry: list[Rule] = REGISTERED_RULES) -> list[Rule]:
    """Registered and active rules, in registry order (rule metadata is a tiny table)."""
    active = {r["rule_code"] for r in rules_table.filter(F.col("is_active")).select("rule_code").collect()}
    return [r for r in registry if r.code in active]


def evaluate_rules(tables: dict, selected: list[Rule], target: DataFrame | None) -> DataFrame | None:
    parts = [r.evaluate(tables, target) for r in selected]
    return reduce(DataFrame.unionByName, parts) if parts else None


def latest_run_status(run_log: DataFrame) -> DataFrame:
    """The run log is append-only; the current state of a run is its latest row."""
    cols = [c for c in RUN_LOG_SCHEMA.names if c not in ("run_id", "logged_at")]
    return run_log.groupBy("run_id").agg(
        *[F.max_by(c, "logged_at").alias(c) for c in cols], F.max("logged_at").alias("logged_at"))


def begin_run(spark: SparkSession, store: TableStore, started: dt.datetime, status: str = C.RUN_RUNNING,
              batch_id: int | None = None, request_id: str | None = None) -> tuple[int, dict | None]:
    """Number of a new run, its RUNNING row published; and the last row of the same request, if there is one.

    A request that was made before keeps its number.  A new number is one more
    than the largest of the log as it is when the row is published: of two
    runs at once, one finds the log changed and asks again.
    """
    while True:
        log = store.read(RUN_LOG)
        known = None
        if log is not None and request_id is not None:
            same = log.filter(F.col("request_id") == request_id)
            known = next((r.asDict() for r in latest_run_status(same).collect()), None)  # one run a request
        if known is not None and known["status"] == C.RUN_SUCCESS:
            return known["run_id"], known
        run_id = known["run_id"] if known else 1 if log is None else int(log.agg(F.max("run_id")).first()[0] or 0) + 1
        try:
            with store.transaction():
                current = store.read(RUN_LOG)
                largest = 0 if current is None else int(current.agg(F.max("run_id")).first()[0] or 0)
                if known is None and largest >= run_id:
                    continue
                _log(spark, store, run_id, started, None, status, None, None, None, batch_id, request_id, alone=True)
            return run_id, known
        except PublishConflict:
            continue


def run_validation(spark: SparkSession, store: TableStore, target: DataFrame | None = None,
                   batch_id: int | None = None, registry: list[Rule] = REGISTERED_RULES, request_id: str | None = None) -> dict:
    """Sync rules, evaluate the active ones, publish findings and the run's log row together.

    Findings are written after every rule has been evaluated, and published in
    one version with the run's SUCCESS row: a run that fails or is killed leaves
    none.  A failed run logs FAILED with 0 rules / 0 issues and the error text
    (cut to 4000 chars).  Runs with the same ``request_id`` are one run: after a
    success it is not run again, otherwise its findings take the place of any
    that it has.  A ``target`` with months prunes the history to what its
    visits' groups can touch.
    """
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rules_table = store.overwrite("validation_rules", sync_rules(spark, store.read("validation_rules"), now, registry))
    run_id, known = begin_run(spark, store, now, batch_id=batch_id, request_id=request_id)
    if known is not None and known["status"] == C.RUN_SUCCESS:
        found = store.read(RESULTS)
        counts = {} if found is None else _per_rule(found.filter(F.col("run_id") == run_id))
        return {"run_id": run_id, "status": C.RUN_SUCCESS, "results": counts}
    try:
        if target is not None and target.isEmpty():
            selected, findings = [], None
        else:
            selected = active_rules(rules_table, registry)
            tables = {t: store.read(t) for t in ["survey_responses", "stores", "visits", "employees"]}
            findings = evaluate_rules(scoped_history(tables, store.read("survey_days"), target), selected, target)
        with store.transaction():
            counts: dict[str, int] = {}
            if findings is not None:
                out = rules.with_run(findings, run_id, now)
                mine = store.replace_partitions(RESULTS, out, RESULTS_BY, touched=[(run_id, r.code) for r in registry])
                counts = _per_rule(mine)
            per_rule = {r.code: counts.get(r.code, 0) for r in selected}
            _log(spark, store, run_id, now, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), C.RUN_SUCCESS,
                 len(per_rule), sum(per_rule.values()), None, batch_id, request_id)
        return {"run_id": run_id, "status": C.RUN_SUCCESS, "results": per_rule}
    except Exception as exc:
        _log(spark, store, run_id, now, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), C.RUN_FAILED,
             0, 0, str(exc)[:C.RUN_ERROR_MAX_CHARS], batch_id, request_id)
        raise


def scoped_history(tables: dict, survey_days: DataFrame | None, target: DataFrame | None) -> dict:
    """Tables of the rules, the history pruned by month where the target names its months."""
    if target is None or MONTH_COL not in target.columns:
        return tables
    months = [r[0] for r in target.select(MONTH_COL).distinct().collect()]  # those of one delivery
    out = dict(tables)
    if tables["visits"] is not None and MONTH_COL in tables["visits"].columns:
        out["visits"] = rules.gps_history(tables["visits"], months)
    if survey_days is not None and tables["survey_responses"] is not None:
        out["survey_responses"] = rules.osa_history(tables["survey_responses"], survey_days, target, months)
    return out


def _per_rule(findings: DataFrame) -> dict[str, int]:
    return {r["rule_code"]: r["n"] for r in findings.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n")).collect()}


def _log(spark, store, run_id, started, finished, status, n_rules, n_issues, error, batch_id, request_id=None, alone=False) -> None:
    row = (run_id, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), started, finished, status,
           n_rules, n_issues, error, batch_id, request_id)
    store.append(RUN_LOG, spark.createDataFrame([row], RUN_LOG_SCHEMA), alone=alone)
