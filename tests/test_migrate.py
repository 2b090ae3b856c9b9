"""Legacy findings migration: per-field rules on literal legacy rows."""

import json

from shelfscan.operators import migrate
from shelfscan.sources.schema import LEGACY_RESULTS_SCHEMA

OSA = "OSA_UNUSUAL_NON_BY_BANNER"
GPS = "GPS_INCONSISTENT_CHECKIN_SAME_STORE_MONTH"


def test_migrate_rows(spark):
    legacy = [
        (1, OSA, 10, "S1", "E1", "P1", "q", "Non", "msg", "MARJANE", 9, 1, 10, 90.0, None),
        (2, OSA, 11, "S1", "E1", "", "q", "Non", "HIGH: x", None, None, None, None, None, None),
        (3, OSA, None, "S1", "E1", "P2", "q", "distance_meters=12.5", "is 99 meters", "critical banner", None, None, None, None, None),
        (4, GPS, 12, "S2", "E2", None, "q", "visit_gps=(1,2)", "MEDIUM: far, is 1712 meters (1.71 km)", None, None, None, None, None, None),
        (5, "OLD_RULE", None, None, None, None, None, None, "no distance", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(legacy, LEGACY_RESULTS_SCHEMA)
    out = {r.actual_value if r.rule_code != "OLD_RULE" else "old": r for r in migrate.migrate_results(df, 7).collect()}
    a = out["Non"] if False else None
    rows = {r["details_json"] and json.loads(r["details_json"])["legacy_validation_id"]: r
            for r in migrate.migrate_results(df, 7).collect()}
    r1, r2, r3, r4, r5 = (rows[i] for i in range(1, 6))
    assert (r1.entity_type, r1.entity_id, r1.expected_value, float(r1.metric_value), r1.severity) == \
        ("survey_response", "10:P1", "Oui", 90.0, "MEDIUM")
    assert (r2.entity_id, r2.severity, r2.metric_value) == ("11", "HIGH", None)
    assert (r3.entity_id, r3.severity, float(r3.metric_value)) == ("P2", "HIGH", 12.5)   # response wins over message
    assert (r4.entity_type, r4.entity_id, r4.expected_value, float(r4.metric_value)) == ("visit", "12", None, 1712.0)
    assert (r5.entity_id, r5.severity, r5.run_id) == (None, "MEDIUM", 7)
    d1, d4, d5 = (json.loads(r.details_json) for r in (r1, r4, r5))
    assert "distance_meters" not in d1 and d1["banner"] == "MARJANE" and d1["availability_rate"] == 90.0
    assert d4["distance_meters"] == 1712.0 and "banner" not in d4 and d4["migrated_from_old_schema"] is True
    assert "distance_meters" not in d5 and d5["legacy_banner"] is None


def test_rule_metadata_and_migrated_check(spark):
    df = spark.createDataFrame([(1, OSA), (2, "OLD_RULE"), (3, "GPS_STORE_LOCATION_INCONSISTENCY_GT")],
                               "validation_id bigint, rule_code string")
    meta = {r.rule_code: r for r in migrate.migrated_rule_meta(spark, df).collect()}
    assert meta[OSA].source_table == "survey_responses"
    assert meta["OLD_RULE"].rule_name == "OLD_RULE" and meta["OLD_RULE"].source_table == "unknown"
    assert meta["GPS_STORE_LOCATION_INCONSISTENCY_GT"].severity == "HIGH"
    assert migrate.is_already_migrated(migrate.MIGRATED_COLUMNS + ["validation_id"])
    assert not migrate.is_already_migrated(["validation_id", "rule_code", "banner"])
