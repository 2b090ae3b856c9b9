"""Rule metadata sync, active-rule selection and the failed-run path."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfscan.plans import validation as V
from shelfscan.sources.store import TableStore
from conftest import SF_SMALL

NOW = dt.datetime(2024, 2, 1)


def test_sync_keeps_switched_off_rule_off(spark):
    first = V.sync_rules(spark, None, NOW)
    assert {r.rule_code: r.is_active for r in first.collect()} == {
        "OSA_UNUSUAL_NON_BY_BANNER": True, "GPS_INCONSISTENT_CHECKIN_SAME_STORE_MONTH": True}
    off = first.withColumn("is_active", F.col("rule_code") != "GPS_INCONSISTENT_CHECKIN_SAME_STORE_MONTH") \
               .withColumn("rule_name", F.lit("old name"))
    later = V.sync_rules(spark, off, NOW + dt.timedelta(days=1))
    rows = {r.rule_code: r for r in later.collect()}
    gps = rows["GPS_INCONSISTENT_CHECKIN_SAME_STORE_MONTH"]
    assert gps.is_active is False and gps.rule_name != "old name" and gps.created_at == NOW
    assert [r.code for r in V.active_rules(later)] == ["OSA_UNUSUAL_NON_BY_BANNER"]


def test_failed_run_is_logged_without_findings(spark, tmp_root):
    store = TableStore(spark, tmp_root)

    def boom(tables, target):
        raise RuntimeError("x" * 5000)
    bad = V.Rule("BROKEN_RULE", "broken", "always fails", "visits", "MEDIUM", boom)
    # base tables are not needed: the rule fails before reading them
    with pytest.raises(RuntimeError):
        V.run_validation(spark, store, registry=[bad])
    log = V.latest_run_status(store.read("validation_run_log")).collect()
    assert len(log) == 1
    r = log[0]
    assert (r.status, r.rules_executed, r.issues_found) == ("FAILED", 0, 0)
    assert len(r.error_message) == 4000
    assert store.read("validation_results") is None


def test_run_log_query_reads_the_log(spark, monkeypatch):
    from shelfscan.plans import catalog

    made, run = [], V.run_validation

    def with_other_runs(spark, store, target=None):
        made.append((store, run(spark, store, target)))
        if len(made) == 2:  # a run without findings and a failed one come last
            run(spark, store, target.limit(0))

            def fail(tables, target):
                raise RuntimeError("no")

            with pytest.raises(RuntimeError):
                run(spark, store, registry=[V.Rule(V.OSA_RULE.code, "n", "d", "t", "s", fail)])

    monkeypatch.setattr(V, "run_validation", with_other_runs)
    got = [tuple(r) for r in catalog.QUERIES["run_log"](spark, SF_SMALL).collect()]
    found = [sum(r["results"].values()) for _, r in made]
    assert got == [(4, "FAILED", 0, 0), (3, "SUCCESS", 0, 0), (2, "SUCCESS", 2, found[1]), (1, "SUCCESS", 2, found[0])]
