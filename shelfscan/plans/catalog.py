"""Query catalog: one DataFrame builder per operator id of the blueprint.

Each builder takes (spark, sf_dir), reads the whole test tables at ``sf_dir``
through the fixture adapter and returns a lazy DataFrame.  Column names are
the contract shared with the SQL oracle (``plans/oracle.py``).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import GPS_RULE_CODE, OSA_RULE_CODE
from ..functions import (clean_float, clean_text, epoch_micros, parse_dateid, parse_excel_serial,
                         question_to_column, round_to_second, week_mode1)
from ..operators import dims, migrate, pivot, reports, routing, rules, sos, survey
from ..operators.scan import prefix_count
from ..session import checkpoint_dir, compile_small
from ..sources.export import export_rows, scan_export
from ..sources.schema import SOURCE_COLUMNS, SURVEY_COLUMNS
from ..sources.store import MONTH_COL, TableStore, with_visit_month
from . import etl, migration, validation
from .context import FixtureContext

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = _fresh(fn)
        return fn
    return deco


def _fresh(fn: Builder) -> Builder:
    """Return a new DataFrame on top of the (shared, memoised) plan.

    Shared context frames are only analysed, never executed themselves, so
    executed physical plans (and their broadcast relations) belong to the
    returned wrapper and are released with it.
    """
    def build(spark, sf_dir):
        return fn(spark, sf_dir).select("*")
    build.__name__ = getattr(fn, "__name__", "query")
    return build


_CONTEXTS: dict[tuple, FixtureContext] = {}


def reset() -> None:
    """Drop every memoised context and release what it persisted."""
    for ctx in _CONTEXTS.values():
        ctx.close()
    _CONTEXTS.clear()


def _ctx(spark, sf_dir) -> FixtureContext:
    """One lazy context per (session, directory): shared DataFrames are
    constructed (analysed) once and reused by every query of the session."""
    # the session's own id: that of a Python proxy can come again after it is gone
    compile_small(spark)
    key = (spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID(), sf_dir.rstrip("/"))
    ctx = _CONTEXTS.get(key)
    if ctx is None:
        ctx = _CONTEXTS[key] = FixtureContext(spark, sf_dir)
    return ctx


# ------------------------------------------------------------- sources ----

#: Rows of one file of the written export; a longer table has more files.
EXPORT_ROWS = 1 << 17


@query("scan_export")
def q_scan_export(spark, sf_dir):
    """The fixture written as CSV files, as a field tool delivers them, and scanned.

    Some answers go on over a line feed.  ``src_ordinal`` is each row's place
    in the order of the files, from 1.
    """
    c = _ctx(spark, sf_dir)
    files = max(4, c.src.count() // EXPORT_ROWS)
    src = c.src.repartitionByRange(files, "src_ordinal").sortWithinPartitions("src_ordinal").withColumn(
        "response", F.when(F.col("src_ordinal") % 17 == 0, F.concat("response", F.lit('\nsuite "2", fin'))).otherwise(F.col("response")))
    path = f"{checkpoint_dir(spark)}/export/{uuid.uuid4().hex}"
    (export_rows(src).drop("src_ordinal").write
     .option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    # parsed once, then read by each step of the numbering
    scanned = c.keep(scan_export(spark, path, "csv"))
    numbered = prefix_count(scanned.withColumn("_row", F.lit(True)), [], "src_ordinal", "_row", "place", EXPORT_ROWS)
    return numbered.withColumn("src_ordinal", F.col("place") + 1).select(*SOURCE_COLUMNS)


@query("parse_dateid")
def q_parse_dateid(spark, sf_dir):
    src = _ctx(spark, sf_dir).src
    ymd = F.date_format("responsedate", "yyyyMMdd")
    # Export text as delivered: a float-formatted id on every 17th row and a
    # month-13 typo on every 19th must parse to null.
    raw = (F.when(F.col("src_ordinal") % 17 == 0, F.concat(ymd, F.lit(".0")))
            .when(F.col("src_ordinal") % 19 == 0, F.concat(F.substring(ymd, 1, 4), F.lit("13"), F.substring(ymd, 7, 2)))
            .otherwise(ymd))
    return src.select("src_ordinal", raw.alias("dateid")).withColumn("visit_date", parse_dateid("dateid"))


@query("parse_excel_serial")
def q_parse_excel_serial(spark, sf_dir):
    src = _ctx(spark, sf_dir).src
    serial = epoch_micros("responsedate").cast("double") / F.lit(86400000000.0) + F.lit(25569.0)
    out = src.select("src_ordinal", serial.alias("serial"))
    out = out.withColumn("responsedate", parse_excel_serial(F.col("serial").cast("string")))
    return out.withColumn("response_datetime", round_to_second("responsedate"))


@query("clean_text")
def q_clean_text(spark, sf_dir):
    src = _ctx(spark, sf_dir).src
    return src.select("src_ordinal", *[clean_text(c).alias(c) for c in
                                       ["username", "store_name", "store_format", "task", "title", "question", "response"]])


@query("clean_float")
def q_clean_float(spark, sf_dir):
    src = _ctx(spark, sf_dir).src
    return src.select("src_ordinal", "response", clean_float("response").alias("response_number"))


@query("question_to_column")
def q_question_to_column(spark, sf_dir):
    src = _ctx(spark, sf_dir).src
    q = src.select(clean_text("question").alias("question")).filter(F.col("question").isNotNull()).distinct()
    return q.withColumn("question_col", question_to_column("question"))


@query("week_mode1")
def q_week_mode1(spark, sf_dir):
    src = _ctx(spark, sf_dir).src
    rt = round_to_second("responsedate")
    return src.select("src_ordinal", rt.alias("response_datetime"), F.year(rt).alias("year_num"),
                      week_mode1(rt).alias("week_num"))


# --------------------------------------------------------- base tables ----

@query("build_employees")
def q_build_employees(spark, sf_dir):
    return dims.build_employees(_ctx(spark, sf_dir).src).drop("first_ordinal")


@query("build_stores")
def q_build_stores(spark, sf_dir):
    return dims.build_stores(_ctx(spark, sf_dir).src).drop("first_ordinal")


@query("build_products")
def q_build_products(spark, sf_dir):
    return dims.build_products(_ctx(spark, sf_dir).src).drop("first_ordinal")


@query("build_visits")
def q_build_visits(spark, sf_dir):
    return dims.build_visits(_ctx(spark, sf_dir).src).drop("first_ordinal")


@query("merge_employees")
def q_merge_employees(spark, sf_dir):
    return _ctx(spark, sf_dir).load2["employees"]


@query("merge_stores")
def q_merge_stores(spark, sf_dir):
    return _ctx(spark, sf_dir).load2["stores"]


@query("merge_products")
def q_merge_products(spark, sf_dir):
    return _ctx(spark, sf_dir).load2["products"]


@query("merge_visits")
def q_merge_visits(spark, sf_dir):
    return _ctx(spark, sf_dir).load2["visits"]


@query("semi_target")
def q_semi_target(spark, sf_dir):
    """Visits touched by the afternoon delivery (after the merge)."""
    return _ctx(spark, sf_dir).affected


@query("visit_lookup")
def q_visit_lookup(spark, sf_dir):
    return _ctx(spark, sf_dir).lookup


# --------------------------------------------------------------- survey ----

@query("filter_store_format")
def q_filter_store_format(spark, sf_dir):
    return survey.filter_store_format(_ctx(spark, sf_dir).src).select("src_ordinal", "store_format")


@query("build_survey")
def q_build_survey(spark, sf_dir):
    return _ctx(spark, sf_dir).survey


def _survey_store(c: FixtureContext) -> tuple[TableStore, DataFrame]:
    """A store with the survey of the morning load, and the afternoon's visits with their months."""
    store = c.new_store("survey")
    months = with_visit_month(c.load2["visits"]).select("visit_id", MONTH_COL)
    store.overwrite("survey_responses", c.survey_of(c.deliveries[0], c.load1).join(months, "visit_id"), [MONTH_COL])
    return store, c.keep(months.join(c.affected, "visit_id", "left_semi"))


@query("replace_by_visit")
def q_replace_by_visit(spark, sf_dir):
    """Survey table after the morning load, then the afternoon load replacing its visits, read back."""
    c = _ctx(spark, sf_dir)
    store, affected = _survey_store(c)
    new = c.survey_of(c.deliveries[1], c.load2).join(affected, "visit_id")
    return etl.replace_visits(store, "survey_responses", new, affected).select(*SURVEY_COLUMNS)


@query("delete_visit_payload")
def q_delete_visit_payload(spark, sf_dir):
    """Survey table after the morning load without the visits of the afternoon, which bring no rows."""
    store, affected = _survey_store(_ctx(spark, sf_dir))
    none = store.read("survey_responses").limit(0)
    return etl.replace_visits(store, "survey_responses", none, affected).select(*SURVEY_COLUMNS)


# -------------------------------------------------------- task routing ----

@query("route_task_table")
def q_route_task_table(spark, sf_dir):
    return routing.route_task_table(_ctx(spark, sf_dir).src).select("src_ordinal", "target_table")


@query("unmatched_rows")
def q_unmatched_rows(spark, sf_dir):
    return routing.unmatched_rows(_ctx(spark, sf_dir).src).select("src_ordinal", "task", "title")


@query("filter_glace")
def q_filter_glace(spark, sf_dir):
    routed = routing.route_task_table(_ctx(spark, sf_dir).src)
    kept = routing.filter_glace(routed)
    return routed.join(kept.select("src_ordinal"), "src_ordinal", "left_anti").select("src_ordinal", "task", "target_table")


@query("tag_task_rows")
def q_tag_task_rows(spark, sf_dir):
    return _ctx(spark, sf_dir).tagged.select("src_ordinal", "target_table", "visit_id", "product_id")


@query("batch_task_tables")
def q_batch_task_tables(spark, sf_dir):
    return routing.batch_task_tables(_ctx(spark, sf_dir).tagged)


@query("question_suffix")
def q_question_suffix(spark, sf_dir):
    return _ctx(spark, sf_dir).dictionary


def _wide(table):
    def build(spark, sf_dir):
        return _ctx(spark, sf_dir).wide(table)
    return build


QUERIES["pivot_questions"] = _fresh(_wide("task_location_checkin"))
QUERIES["pivot_osa"] = _fresh(_wide("task_osa_pack_coc_mh"))
QUERIES["pivot_price"] = _fresh(_wide("task_price"))
QUERIES["pivot_shelf"] = _fresh(_wide("task_primary_shelf_placement"))
QUERIES["pivot_deviation"] = _fresh(_wide("task_callcycle_deviation"))


@query("task_answers")
def q_task_answers(spark, sf_dir):
    return pivot.task_answers(_ctx(spark, sf_dir).tagged, "task_osa_pack_coc_mh")


@query("sos_blocks")
def q_sos_blocks(spark, sf_dir):
    return sos.sos_blocks(_ctx(spark, sf_dir).tagged)


@query("deviation_summary")
def q_deviation_summary(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return reports.deviation_summary(c.wide("task_callcycle_deviation"), c.visits, c.employees)


# ---------------------------------------------------------------- rules ----

@query("filter_osa_base")
def q_filter_osa_base(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return rules.osa_base(c.survey, c.stores).select("visit_id", "product_code", "question", "response",
                                                     "banner", "year_num", "week_num")


@query("agg_osa_weekly")
def q_agg_osa_weekly(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    w = rules.osa_weekly(rules.osa_base(c.survey, c.stores))
    return w.withColumn("availability_rate", F.col("availability_rate").cast("double"))


@query("osa_unusual_non")
def q_osa_unusual_non(spark, sf_dir):
    return _ctx(spark, sf_dir).osa_found


@query("filter_gps_valid")
def q_filter_gps_valid(spark, sf_dir):
    return _ctx(spark, sf_dir).gps_rows.select("visit_id", "employee_code", "store_code", "year_num",
                                               "month_num", "latitude", "longitude")


@query("agg_gps_median")
def q_agg_gps_median(spark, sf_dir):
    m = rules.gps_medians(_ctx(spark, sf_dir).gps_rows)
    return m.select(*rules.GPS_GROUP, "total_visits_in_group", "median_latitude", "median_longitude").distinct()


@query("join_gps_cluster")
def q_join_gps_cluster(spark, sf_dir):
    m = rules.gps_medians(_ctx(spark, sf_dir).gps_rows)
    d = rules.haversine_m("latitude", "longitude", "median_latitude", "median_longitude")
    return m.select("visit_id", "total_visits_in_group", "median_latitude", "median_longitude",
                    rules.round_dec(d, 2).cast("decimal(14,2)").alias("distance_meters"))


@query("gps_inconsistent")
def q_gps_inconsistent(spark, sf_dir):
    return _ctx(spark, sf_dir).gps_found


def _typed_findings(f: DataFrame) -> DataFrame:
    return f.select("run_id", "rule_code", "entity_type", "entity_id", "visit_id", "store_code", "employee_code",
                    "product_code", "question", "actual_value", "expected_value", "metric_value", "message",
                    "severity")


@query("union_findings")
def q_union_findings(spark, sf_dir):
    return _typed_findings(_ctx(spark, sf_dir).findings_run1)


@query("target_scope")
def q_target_scope(spark, sf_dir):
    return _typed_findings(_ctx(spark, sf_dir).findings_run2)


@query("details_osa")
def q_details_osa(spark, sf_dir):
    f = _ctx(spark, sf_dir).findings_run1.filter(F.col("rule_code") == OSA_RULE_CODE)
    schema = "banner string, weekly_expected_response string, yes_count bigint, no_count bigint, " \
             "total_answers bigint, availability_rate double"
    return f.select("visit_id", "entity_id", F.from_json("details_json", schema).alias("d")).select(
        "visit_id", "entity_id", "d.*")


@query("details_gps")
def q_details_gps(spark, sf_dir):
    f = _ctx(spark, sf_dir).findings_run1.filter(F.col("rule_code") == GPS_RULE_CODE)
    schema = ("visit_date string, store_name string, username string, year_num int, month_num int, "
              "visit_latitude double, visit_longitude double, median_latitude double, median_longitude double, "
              "distance_meters double, distance_km double, total_visits_in_group bigint, "
              "warning_threshold_meters int, high_threshold_meters int")
    return f.select("visit_id", F.from_json("details_json", schema).alias("d")).select("visit_id", "d.*")


# -------------------------------------------------------------- reports ----

@query("issue_count_by_rule")
def q_issue_count_by_rule(spark, sf_dir):
    return reports.issue_count_by_rule(_ctx(spark, sf_dir).findings)


@query("issue_count_by_run_rule")
def q_issue_count_by_run_rule(spark, sf_dir):
    return reports.issue_count_by_run_rule(_ctx(spark, sf_dir).findings)


@query("issue_count_by_banner")
def q_issue_count_by_banner(spark, sf_dir):
    return reports.issue_count_by_banner(_ctx(spark, sf_dir).findings)


@query("latest_results")
def q_latest_results(spark, sf_dir):
    return _typed_findings(reports.latest_results(_ctx(spark, sf_dir).findings))


@query("rule_results_view")
def q_rule_results_view(spark, sf_dir):
    return reports.rule_results_view(_ctx(spark, sf_dir).findings)


@query("gps_results_sorted")
def q_gps_results_sorted(spark, sf_dir):
    return _typed_findings(reports.gps_results_sorted(_ctx(spark, sf_dir).findings))


@query("gps_results_report")
def q_gps_results_report(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return reports.gps_results_report(c.findings, c.employees, c.stores, c.visits)


@query("stores_banner_list")
def q_stores_banner_list(spark, sf_dir):
    return reports.stores_banner_list(_ctx(spark, sf_dir).stores)


@query("table_counts")
def q_table_counts(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return reports.table_counts({"employees": c.employees, "stores": c.stores, "products": c.products,
                                 "visits": c.visits, "survey_responses": c.survey})


@query("run_log")
def q_run_log(spark, sf_dir):
    """The log of a run over the whole history and one scoped to the afternoon delivery, read back."""
    c = _ctx(spark, sf_dir)
    store = c.new_store("run-log")
    for name, df in {"survey_responses": c.survey, "stores": c.stores, "visits": c.visits, "employees": c.employees}.items():
        store.overwrite(name, df)
    validation.run_validation(spark, store)
    validation.run_validation(spark, store, store.stage("target", c.affected_single))
    return reports.run_log_desc(validation.latest_run_status(store.read("validation_run_log")))


@query("list_employees")
def q_list_employees(spark, sf_dir):
    return reports.list_employees(_ctx(spark, sf_dir).employees)


#: Days between the deliveries of the ETL queries, so that each has months of its own.
DELIVERY_DAYS = 100


def _three_deliveries(c: FixtureContext) -> list[DataFrame]:
    """Every third row of the fixture each, the visits moved to other months."""
    return [c.src.filter(F.col("src_ordinal") % 3 == k).withColumn("visit_date", F.date_add("visit_date", DELIVERY_DAYS * k)) for k in range(3)]


def _stored_tables(store: TableStore) -> DataFrame:
    """Rows and largest id of every month of the stored tables."""
    ids = {**dims.ID_COLS, "survey_responses": "visit_id", "survey_quarantine": "visit_id"}
    parts = []
    for name, key in ids.items():
        df = store.read(name)
        month = F.col(MONTH_COL) if MONTH_COL in df.columns else F.lit("all")
        parts.append(df.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n_rows"), F.max(key).alias("max_id"))
                     .select(F.lit(name).alias("table_name"), "month", "n_rows", "max_id"))
    return reduce(DataFrame.unionByName, parts)


@query("etl_run")
def q_etl_run(spark, sf_dir):
    """Three deliveries of different months loaded one after the other, the second one twice; the tables read back."""
    c = _ctx(spark, sf_dir)
    store = c.new_store("etl")
    one, two, three = _three_deliveries(c)
    for delivery in (one, two, three, two):
        etl.run_etl(spark, delivery, store)
    return _stored_tables(store)


@query("full_refresh")
def q_full_refresh(spark, sf_dir):
    """Two deliveries, the second as a full refresh: only its rows are left."""
    c = _ctx(spark, sf_dir)
    store = c.new_store("refresh")
    one, two, _ = _three_deliveries(c)
    etl.run_etl(spark, one, store)
    etl.run_etl(spark, two, store, full_refresh=True)
    return _stored_tables(store)


@query("load_task_tables")
def q_load_task_tables(spark, sf_dir):
    """Rows of every task table of a store after two deliveries."""
    c = _ctx(spark, sf_dir)
    store = c.new_store("tasks")
    for delivery in _three_deliveries(c)[:2]:
        etl.run_etl(spark, delivery, store)
    names = [t for t in store.tables() if t.startswith(pivot.TABLE_PREFIX)]
    return reduce(DataFrame.unionByName, [store.read(t).groupBy(MONTH_COL).agg(F.count(F.lit(1)).alias("n_rows"))
                                          .select(F.lit(t).alias("table_name"), F.col(MONTH_COL).alias("month"), "n_rows") for t in names])


@query("evolve_task_schema")
def q_evolve_task_schema(spark, sf_dir):
    """Columns of every task table of a store: after the first delivery, and those that the second one added."""
    c = _ctx(spark, sf_dir)
    store = c.new_store("columns")
    seen: dict[tuple, int] = {}
    for number, delivery in enumerate(_schema_deliveries(c), 1):
        etl.run_etl(spark, delivery, store)
        for table in store.tables():
            if table.startswith(pivot.TABLE_PREFIX):
                for column in store.read(table).columns:
                    seen.setdefault((table, column), number)
    return spark.createDataFrame([(t, c, n) for (t, c), n in seen.items()], "table_name string, column_name string, delivery int")


def _schema_deliveries(c: FixtureContext) -> list[DataFrame]:
    """Answers about clicks first, and then all of another month."""
    one, two, _ = _three_deliveries(c)
    return [one.filter(~F.coalesce(F.col("question").contains("purchase"), F.lit(False))), two]


@query("evolve_question_columns")
def q_evolve_question_columns(spark, sf_dir):
    """The question dictionary of the morning, and after it the afternoon's new questions."""
    c = _ctx(spark, sf_dir)
    tagged = [c.keep(routing.tag_task_rows(d, load["visits"], load["products"])) for d, load in zip(c.deliveries, (c.load1, c.load2))]
    known = c.keep(pivot.question_dictionary(tagged[0]))
    return known.unionByName(pivot.question_dictionary(tagged[1], known))


@query("rules_by_code")
def q_rules_by_code(spark, sf_dir):
    """Rule metadata as a run's rule sync leaves it."""
    now = dt.datetime(2024, 1, 1)
    return reports.rules_by_code(validation.sync_rules(spark, None, now))


# ------------------------------------------------------------ migration ----

@query("migrate_results")
def q_migrate_results(spark, sf_dir):
    legacy = migrate.legacy_from_findings(_ctx(spark, sf_dir).findings_run1)
    m = migrate.migrate_results(legacy, 3)
    return m.select(
        "run_id", "rule_code", "entity_type", "entity_id", "visit_id", "store_code", "employee_code",
        "product_code", "question", "actual_value", "expected_value", "metric_value", "message", "severity",
        F.get_json_object("details_json", "$.legacy_banner").alias("legacy_banner"),
        F.get_json_object("details_json", "$.legacy_availability_rate").cast("double").alias("legacy_availability_rate"),
        F.get_json_object("details_json", "$.distance_meters").cast("double").alias("distance_meters"),
        F.get_json_object("details_json", "$.migrated_from_old_schema").alias("migrated_flag"),
    )


@query("mig_rule_meta")
def q_mig_rule_meta(spark, sf_dir):
    legacy = migrate.legacy_from_findings(_ctx(spark, sf_dir).findings_run1)
    return migrate.migrated_rule_meta(spark, legacy)


@query("distinct_rule_codes")
def q_distinct_rule_codes(spark, sf_dir):
    return reports.distinct_rule_codes(migrate.legacy_from_findings(_ctx(spark, sf_dir).findings_run1))


@query("migration_run")
def q_migration_run(spark, sf_dir):
    """A store with legacy findings migrated, twice; findings, rules and runs read back."""
    c = _ctx(spark, sf_dir)
    store = c.new_store("migration")
    store.overwrite("validation_results", migrate.legacy_from_findings(c.findings_run1))
    for _ in range(2):
        migration.run_migration(spark, store)
    results = store.read("validation_results").groupBy("rule_code", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("metric_value").cast("double").alias("metric"))
    rules = store.read("validation_rules").select("rule_code", "severity", F.col("is_active").cast("bigint").alias("n"), F.lit(None).cast("double").alias("metric"))
    runs = validation.latest_run_status(store.read("validation_run_log")).select(
        F.col("status").alias("rule_code"), F.col("rules_executed").cast("string").alias("severity"), F.col("issues_found").alias("n"),
        F.lit(None).cast("double").alias("metric"))
    named = {"validation_results": results, "validation_rules": rules, "validation_run_log": runs}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), "*") for name, df in named.items()])
