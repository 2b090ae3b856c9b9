"""Legacy findings -> generic findings schema, as one select over the old rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import (GPS_RULE_CODE, GPS_RULE_DESCRIPTION, GPS_RULE_NAME, GPS_SEVERITY,
                         GPS_SOURCE_TABLE, LEGACY_GT_DESCRIPTION, LEGACY_GT_RULE_CODE,
                         LEGACY_GT_RULE_NAME, LEGACY_GT_SEVERITY, LEGACY_GT_SOURCE_TABLE,
                         LEGACY_UNKNOWN_DESCRIPTION, LEGACY_UNKNOWN_SEVERITY,
                         LEGACY_UNKNOWN_SOURCE_TABLE, OSA_RULE_CODE, OSA_RULE_DESCRIPTION,
                         OSA_RULE_NAME, OSA_SEVERITY, OSA_SOURCE_TABLE, OSA_YES)

# FIXED VALUES: patterns that carry a distance in legacy text, tried in this order.
DISTANCE_PATTERNS = [r"distance_meters=(\d+(?:\.\d+)?)", r"is (\d+(?:\.\d+)?) meters"]

KNOWN_RULES = [
    (OSA_RULE_CODE, OSA_RULE_NAME, OSA_RULE_DESCRIPTION, OSA_SOURCE_TABLE, OSA_SEVERITY),
    (GPS_RULE_CODE, GPS_RULE_NAME, GPS_RULE_DESCRIPTION, GPS_SOURCE_TABLE, GPS_SEVERITY),
    (LEGACY_GT_RULE_CODE, LEGACY_GT_RULE_NAME, LEGACY_GT_DESCRIPTION, LEGACY_GT_SOURCE_TABLE, LEGACY_GT_SEVERITY),
]

MIGRATED_COLUMNS = ["run_id", "rule_code", "entity_type", "entity_id", "visit_id", "store_code",
                    "employee_code", "product_code", "question", "actual_value", "expected_value",
                    "metric_value", "message", "severity", "details_json", "detected_at"]


def legacy_from_findings(findings: DataFrame) -> DataFrame:
    """Old-schema rows as the pre-migration system stored them (used to drive tests)."""
    d = F.col("details_json")
    is_osa = F.col("rule_code") == OSA_RULE_CODE
    return findings.select(
        F.col("visit_id").alias("validation_id"), "rule_code", "visit_id", "store_code", "employee_code",
        "product_code", "question", F.col("actual_value").alias("response"), "message",
        F.when(is_osa, F.get_json_object(d, "$.banner")).alias("banner"),
        F.when(is_osa, F.get_json_object(d, "$.yes_count").cast("bigint")).alias("yes_count"),
        F.when(is_osa, F.get_json_object(d, "$.no_count").cast("bigint")).alias("no_count"),
        F.when(is_osa, F.get_json_object(d, "$.total_answers").cast("bigint")).alias("total_answers"),
        F.when(is_osa, F.get_json_object(d, "$.availability_rate").cast("double")).alias("availability_rate"),
        (F.col("detected_at") if "detected_at" in findings.columns
         else F.lit(None).cast("timestamp_ntz")).alias("detected_at"),
    )


def parse_distance_meters() -> F.Column:
    """First distance found: response then message, each with both patterns in order."""
    texts = [F.coalesce(F.col("response"), F.lit("")), F.coalesce(F.col("message"), F.lit(""))]
    hits = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for t in texts for p in DISTANCE_PATTERNS]
    return F.coalesce(*hits).cast("double")


def derive_severity() -> F.Column:
    banner = F.upper(F.coalesce(F.col("banner"), F.lit("")))
    message = F.upper(F.coalesce(F.col("message"), F.lit("")))
    high = (banner.contains("CRITICAL") | banner.contains("HIGH")
            | message.contains("CRITICAL:") | message.contains("HIGH:"))
    return F.when(high, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def map_entity_id() -> F.Column:
    visit = F.col("visit_id").cast("string")
    prod = F.col("product_code")
    has_prod = prod.isNotNull() & (prod != "")
    osa = (F.when(F.col("visit_id").isNotNull() & has_prod, F.concat(visit, F.lit(":"), prod))
            .when(F.col("visit_id").isNotNull(), visit).otherwise(prod))
    return F.when(F.col("rule_code") == OSA_RULE_CODE, osa).otherwise(visit)


def _details(with_distance: bool, with_osa: bool) -> F.Column:
    rate = F.col("availability_rate").cast("double")
    fields = [
        F.col("validation_id").alias("legacy_validation_id"), F.col("banner").alias("legacy_banner"),
        F.col("response").alias("legacy_response"), F.col("no_count").alias("legacy_no_count"),
        F.col("yes_count").alias("legacy_yes_count"), F.col("total_answers").alias("legacy_total_answers"),
        rate.alias("legacy_availability_rate"), F.lit(True).alias("migrated_from_old_schema"),
    ]
    if with_distance:
        fields.append(F.col("_distance").alias("distance_meters"))
    if with_osa:
        fields += [F.col("banner"), F.col("yes_count"), F.col("no_count"), F.col("total_answers"),
                   rate.alias("availability_rate")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def migrate_results(legacy: DataFrame, migration_run_id) -> DataFrame:
    """Old rows -> generic findings; keys absent in the old row stay absent in the details."""
    df = legacy.withColumn("_distance", parse_distance_meters())
    is_osa = F.col("rule_code") == OSA_RULE_CODE
    has_d = F.col("_distance").isNotNull()
    details = (F.when(has_d & is_osa, _details(True, True)).when(has_d, _details(True, False))
                .when(is_osa, _details(False, True)).otherwise(_details(False, False)))
    return df.select(
        F.lit(migration_run_id).cast("bigint").alias("run_id"), "rule_code",
        F.when(is_osa, F.lit("survey_response")).otherwise(F.lit("visit")).alias("entity_type"),
        map_entity_id().alias("entity_id"), "visit_id", "store_code", "employee_code", "product_code",
        "question", F.col("response").alias("actual_value"),
        F.when(is_osa, F.lit(OSA_YES)).alias("expected_value"),
        F.coalesce(F.col("availability_rate").cast("double"), F.col("_distance")).cast("decimal(12,4)")
         .alias("metric_value"),
        "message", derive_severity().alias("severity"), details.alias("details_json"), "detected_at",
    )


def known_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_RULES, "rule_code string, rule_name string, description string, "
                                              "source_table string, severity string")


def migrated_rule_meta(spark: SparkSession, legacy: DataFrame) -> DataFrame:
    """Rule rows for every code found in the legacy table (known metadata, else generic)."""
    codes = legacy.select("rule_code").distinct()
    k = F.broadcast(known_rules(spark))  # three fixed rows
    j = codes.join(k, "rule_code", "left")
    return j.select(
        "rule_code", F.coalesce("rule_name", "rule_code").alias("rule_name"),
        F.coalesce("description", F.lit(LEGACY_UNKNOWN_DESCRIPTION)).alias("description"),
        F.coalesce("source_table", F.lit(LEGACY_UNKNOWN_SOURCE_TABLE)).alias("source_table"),
        F.coalesce("severity", F.lit(LEGACY_UNKNOWN_SEVERITY)).alias("severity"),
        F.lit(True).alias("is_active"))


def is_already_migrated(columns: list[str]) -> bool:
    return set(MIGRATED_COLUMNS) <= set(columns)
