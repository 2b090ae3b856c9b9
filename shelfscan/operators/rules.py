"""Data-quality rules over the full history.

Both rules return typed finding rows; ``to_findings`` maps them to the shared
findings schema (details as a JSON string at that boundary only).  A target
(affected visits) limits the *findings*, never the baselines: the weekly /
monthly groups touched by the target are found first and only those groups
are aggregated over the whole history, which gives the same findings as
"evaluate everything, then keep target visits".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import (GPS_ENTITY_TYPE, GPS_MIN_VISITS_PER_MONTH, GPS_RULE_CODE,
                         GPS_RULE_QUESTION, GPS_WARNING_DISTANCE_METERS, GPS_HIGH_DISTANCE_METERS,
                         OSA_ENTITY_TYPE, OSA_MIN_ANSWERS, OSA_MIN_RATE, OSA_MIN_YES, OSA_NO,
                         OSA_QUESTION_KEYWORD, OSA_RULE_CODE, OSA_SEVERITY, OSA_YES)
from ..functions import case_banner, gps_severity, haversine_m, week_mode1
from ..sources.schema import FINDINGS_COLUMNS


def round_dec(x, scale: int) -> F.Column:
    """Round a double through DECIMAL (exact decimal half-up, engine independent)."""
    return F.round(x.cast("decimal(24,10)"), scale)


# --------------------------------------------------- history of a scoped run ----

def gps_history(visits: DataFrame, months: list[str]) -> DataFrame:
    """Visits of the months of a target: its groups are months of visits, so that no other can matter."""
    return visits.filter(F.col("visit_month").isin(months))


def osa_history(survey: DataFrame, days: DataFrame, target: DataFrame, months: list[str]) -> DataFrame:
    """Answers of the months of visits that a week of the target's answers can touch.

    ``days`` has the first and last day of the answers of each month of visits
    (an answer's week need not lie in its visit's month).  Weeks of a year are
    parts of weeks from Monday to Sunday.
    """
    mine = survey.filter(F.col("visit_month").isin(months)).join(target.select("visit_id").distinct(), "visit_id", "left_semi")
    weeks = mine.filter("response_datetime is not null").select(F.date_trunc("week", "response_datetime").cast("date").alias("monday")).distinct()
    touched = days.join(weeks, (F.col("first_day") <= F.date_add("monday", 6)) & (F.col("last_day") >= F.col("monday")), "left_semi")
    return survey.filter(F.col("visit_month").isin([r[0] for r in touched.select("visit_month").distinct().collect()]))


# ------------------------------------------------------------------- GPS ----

GPS_GROUP = ["employee_code", "store_code", "year_num", "month_num"]


def visit_gps(visits: DataFrame, employees: DataFrame, stores: DataFrame) -> DataFrame:
    """Visits with a usable position (no null date / coordinate, no zero on either axis)."""
    v = visits.filter(F.col("visit_date").isNotNull() & F.col("latitude").isNotNull()
                      & F.col("longitude").isNotNull() & (F.col("latitude") != 0) & (F.col("longitude") != 0))
    return (v.select("visit_id", "visit_date", "employee_id", "store_id",
                     F.col("latitude").cast("decimal(10,6)").alias("latitude"),
                     F.col("longitude").cast("decimal(10,6)").alias("longitude"))
            .join(employees.select("employee_id", "employee_code", "username"), "employee_id")
            .join(stores.select("store_id", "store_code", "store_name"), "store_id")
            .withColumn("year_num", F.year("visit_date"))
            .withColumn("month_num", F.month("visit_date")))


def _median(sorted_arr: F.Column, n: F.Column) -> F.Column:
    lo = F.element_at(sorted_arr, ((n + 1) / 2).cast("int"))
    hi = F.element_at(sorted_arr, (n / 2).cast("int") + 1)
    return ((lo + hi) * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(12,7)")


def gps_medians(gps: DataFrame) -> DataFrame:
    """Per visit: size and exact median position of its (employee, store, month) group.

    Visits are unique per (date, employee, store), so a group holds at most 31
    visits: the window buffers a proven-small group, and the whole rule costs
    one shuffle on the group key with no join back.
    """
    w = Window.partitionBy(*GPS_GROUP)
    return (gps.withColumn("total_visits_in_group", F.count(F.lit(1)).over(w))
               .withColumn("_lats", F.array_sort(F.collect_list("latitude").over(w)))
               .withColumn("_lons", F.array_sort(F.collect_list("longitude").over(w)))
               .withColumn("median_latitude", _median(F.col("_lats"), F.col("total_visits_in_group")))
               .withColumn("median_longitude", _median(F.col("_lons"), F.col("total_visits_in_group")))
               .drop("_lats", "_lons"))


def gps_inconsistent(gps: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Visits farther than 1000 m from their group's median (groups of >= 3 visits)."""
    if target is not None:
        touched = gps.join(target.select("visit_id").distinct(), "visit_id", "left_semi").select(*GPS_GROUP).distinct()
        gps = gps.join(touched, GPS_GROUP, "left_semi")
    m = gps_medians(gps).filter(F.col("total_visits_in_group") >= GPS_MIN_VISITS_PER_MONTH)
    d = haversine_m("latitude", "longitude", "median_latitude", "median_longitude")
    m = m.withColumn("_d", d).filter(F.col("_d") > GPS_WARNING_DISTANCE_METERS)
    if target is not None:
        m = m.join(target.select("visit_id").distinct(), "visit_id", "left_semi")
    dist_m = round_dec(F.col("_d"), 2)
    dist_km = round_dec(F.col("_d") / 1000, 3)
    lat6 = F.round(F.col("median_latitude"), 6).cast("decimal(10,6)").cast("string")
    lon6 = F.round(F.col("median_longitude"), 6).cast("decimal(10,6)").cast("string")
    sev = gps_severity(F.col("_d"))
    message = F.concat(
        sev, F.lit(": GPS check-in for "), F.col("employee_code"), F.lit(" at store "), F.col("store_code"),
        F.lit(" ("), F.coalesce(F.col("store_name"), F.lit("Unknown store")), F.lit(") on "),
        F.date_format("visit_date", "yyyy-MM-dd"), F.lit(" is "),
        round_dec(F.col("_d"), 0).cast("decimal(20,0)").cast("string"), F.lit(" meters ("),
        round_dec(F.col("_d") / 1000, 2).cast("string"),
        F.lit(" km) away from the normal monthly GPS zone. This store was visited "),
        F.col("total_visits_in_group").cast("string"),
        F.lit(" times by the same merchandiser in "), F.col("year_num").cast("string"), F.lit("-"),
        F.lpad(F.col("month_num").cast("string"), 2, "0"), F.lit("."))
    return m.select(
        "visit_id", "employee_code", "store_code", "store_name", "username", "visit_date",
        "year_num", "month_num",
        F.col("latitude").alias("visit_latitude"), F.col("longitude").alias("visit_longitude"),
        "median_latitude", "median_longitude",
        F.col("total_visits_in_group").cast("bigint").alias("total_visits_in_group"),
        dist_m.cast("decimal(14,2)").alias("distance_meters"),
        dist_km.cast("decimal(14,3)").alias("distance_km"),
        sev.alias("severity"),
        F.col("visit_id").cast("string").alias("entity_id"),
        F.concat(F.lit("visit_gps=("), F.col("latitude").cast("string"), F.lit(","),
                 F.col("longitude").cast("string"), F.lit(")")).alias("actual_value"),
        F.concat(F.lit("monthly_cluster_gps=("), lat6, F.lit(","), lon6, F.lit(")")).alias("expected_value"),
        message.alias("message"),
    )


def gps_findings(found: DataFrame) -> DataFrame:
    details = F.struct(
        F.date_format("visit_date", "yyyy-MM-dd").alias("visit_date"), "store_name", "username",
        "year_num", "month_num",
        F.col("visit_latitude").cast("double").alias("visit_latitude"),
        F.col("visit_longitude").cast("double").alias("visit_longitude"),
        F.col("median_latitude").cast("double").alias("median_latitude"),
        F.col("median_longitude").cast("double").alias("median_longitude"),
        F.col("distance_meters").cast("double").alias("distance_meters"),
        F.col("distance_km").cast("double").alias("distance_km"),
        "total_visits_in_group",
        F.lit(GPS_WARNING_DISTANCE_METERS).alias("warning_threshold_meters"),
        F.lit(GPS_HIGH_DISTANCE_METERS).alias("high_threshold_meters"),
    )
    return found.select(
        F.lit(GPS_RULE_CODE).alias("rule_code"), F.lit(GPS_ENTITY_TYPE).alias("entity_type"),
        "entity_id", F.col("visit_id").cast("bigint").alias("visit_id"), "store_code", "employee_code",
        F.lit(None).cast("string").alias("product_code"), F.lit(GPS_RULE_QUESTION).alias("question"),
        "actual_value", "expected_value",
        F.col("distance_meters").cast("decimal(12,4)").alias("metric_value"),
        "message", "severity",
        F.to_json(details, {"ignoreNullFields": "false"}).alias("details_json"),
    )


# ------------------------------------------------------------------- OSA ----

OSA_GROUP = ["year_num", "week_num", "banner", "product_code", "question"]


def osa_base(survey: DataFrame, stores: DataFrame, collation: str | None = None) -> DataFrame:
    """Availability answers (Oui / Non) with product, banner, calendar year and MySQL week.

    ``collation`` (e.g. ``UNICODE_CI_AI``) makes answer tests and the weekly
    grouping keys case- / accent-insensitive, like a database default
    collation; by default texts compare exactly.
    """
    if collation:
        survey = survey.select(*[F.collate(F.col(c), collation).alias(c) if c in ("response", "question", "product_code")
                                 else F.col(c) for c in survey.columns])
    s = survey.filter(F.col("product_code").isNotNull() & F.col("response").isin(OSA_YES, OSA_NO)
                      & F.upper(F.col("question")).contains(OSA_QUESTION_KEYWORD))
    banners = stores.select("store_code", case_banner("store_name").alias("banner"))
    return (s.select("visit_id", "employee_code", "store_code", "product_code", "question", "response",
                     "response_datetime")
             .join(banners, "store_code")
             .withColumn("year_num", F.year("response_datetime"))
             .withColumn("week_num", week_mode1("response_datetime")))


def osa_weekly(base: DataFrame) -> DataFrame:
    """Weekly answer counts per (year, week, banner, product, question), strong-Oui groups only.

    A hash aggregate with map-side partial aggregation: a hot banner / product
    collapses to one partial row per task before the shuffle.
    """
    yes = F.sum(F.when(F.col("response") == OSA_YES, 1).otherwise(0))
    no = F.sum(F.when(F.col("response") == OSA_NO, 1).otherwise(0))
    n = F.count(F.lit(1))
    w = base.groupBy(*OSA_GROUP).agg(n.alias("total_answers"), yes.alias("yes_count"), no.alias("no_count"))
    rate = F.round(F.col("yes_count") * F.lit(100.0).cast("decimal(4,1)") / F.nullif(F.col("total_answers"), F.lit(0)), 2)
    return (w.filter((F.col("total_answers") >= OSA_MIN_ANSWERS) & (F.col("yes_count") >= OSA_MIN_YES))
             .withColumn("availability_rate", rate))


def osa_unusual_non(survey: DataFrame, stores: DataFrame, target: DataFrame | None = None,
                    collation: str | None = None) -> DataFrame:
    """'Non' answers inside a week whose rounded Oui rate is >= 80 for the same banner/product/question."""
    base = osa_base(survey, stores, collation)
    nons = base.filter(F.col("response") == OSA_NO)
    if target is not None:
        nons = nons.join(target.select("visit_id").distinct(), "visit_id", "left_semi")
        touched = nons.select(*OSA_GROUP).distinct()
        base = base.join(touched, OSA_GROUP, "left_semi")
    weekly = osa_weekly(base).filter(F.col("availability_rate") >= OSA_MIN_RATE)
    j = nons.join(weekly, OSA_GROUP, "inner")
    rate_txt = F.col("availability_rate").cast("decimal(10,2)").cast("string")
    return j.select(
        "visit_id", "employee_code", "store_code", "product_code", "banner", "question", "response",
        F.col("total_answers").cast("bigint").alias("total_answers"),
        F.col("yes_count").cast("bigint").alias("yes_count"),
        F.col("no_count").cast("bigint").alias("no_count"),
        F.col("availability_rate").cast("double").alias("availability_rate"),
        F.concat_ws(":", F.col("visit_id").cast("string"), F.col("product_code")).alias("entity_id"),
        F.concat(F.lit("OSA response is 'Non' while weekly availability for SKU "), F.col("product_code"),
                 F.lit(" in banner "), F.col("banner"), F.lit(" is "), rate_txt, F.lit("%.")).alias("message"),
    )


def osa_findings(found: DataFrame) -> DataFrame:
    details = F.struct(
        "banner", F.lit(OSA_YES).alias("weekly_expected_response"),
        "yes_count", "no_count", "total_answers", "availability_rate",
    )
    return found.select(
        F.lit(OSA_RULE_CODE).alias("rule_code"), F.lit(OSA_ENTITY_TYPE).alias("entity_type"),
        "entity_id", F.col("visit_id").cast("bigint").alias("visit_id"), "store_code", "employee_code",
        "product_code", "question", F.col("response").alias("actual_value"),
        F.lit(OSA_YES).alias("expected_value"),
        F.col("availability_rate").cast("decimal(12,4)").alias("metric_value"),
        "message", F.lit(OSA_SEVERITY).alias("severity"),
        F.to_json(details, {"ignoreNullFields": "false"}).alias("details_json"),
    )


def with_run(findings: DataFrame, run_id: int, detected_at=None) -> DataFrame:
    ts = F.current_timestamp().cast("timestamp_ntz") if detected_at is None else F.lit(detected_at).cast("timestamp_ntz")
    return findings.select(F.lit(run_id).cast("bigint").alias("run_id"),
                           *[c for c in FINDINGS_COLUMNS if c != "run_id"], ts.alias("detected_at"))
