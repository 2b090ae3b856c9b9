"""Runs that are repeated, history of scoped runs, migration as a job."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import rules
from shelfscan.operators.migrate import legacy_from_findings
from shelfscan.plans import catalog, etl, migration, pipeline
from shelfscan.plans import validation as V
from shelfscan.sources import events_source, split_deliveries
from shelfscan.sources.store import MONTH_COL, TableStore
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """Three months, as three deliveries."""
    store = TableStore(spark, str(tmp_path_factory.mktemp("runs")))
    src = events_source(spark, SF_SMALL)
    for k in range(3):
        part = src.filter(F.col("src_ordinal") % 3 == k).withColumn("visit_date", F.date_add("visit_date", 100 * k)) \
                  .withColumn("responsedate", F.col("responsedate") + F.make_dt_interval(F.lit(100 * k)))
        out = etl.run_etl(spark, part, store)
    return store, out


def findings(store, run_id):
    return sorted((tuple(r) for r in store.read("validation_results").filter(F.col("run_id") == run_id).drop("run_id", "detected_at").collect()), key=repr)


def test_a_request_is_one_run(spark, loaded, monkeypatch):
    store, out = loaded
    real = V._per_rule

    def kill(df):
        raise KeyboardInterrupt  # after the findings were written

    monkeypatch.setattr(V, "_per_rule", kill)
    with pytest.raises(KeyboardInterrupt):
        V.run_validation(spark, store, request_id="feed/7")
    assert store.read("validation_results") is None  # written, but not published
    monkeypatch.setattr(V, "_per_rule", real)
    first = V.run_validation(spark, store, request_id="feed/7")
    again = V.run_validation(spark, store, request_id="feed/7")
    assert first == again and first["run_id"] == 1 and sum(first["results"].values()) == len(findings(store, 1)) > 0
    other = V.run_validation(spark, store, request_id="feed/8")
    assert other["run_id"] == 2 and findings(store, 2) == findings(store, 1)
    assert {r["run_id"] for r in store.read("validation_results").select("run_id").distinct().collect()} == {1, 2}


def test_a_failed_request_keeps_its_number(spark, tmp_root):
    store = TableStore(spark, tmp_root)

    def boom(tables, target):
        raise RuntimeError("no")

    bad = [V.Rule("BAD", "n", "d", "t", "s", boom)]
    for _ in range(2):
        with pytest.raises(RuntimeError):
            V.run_validation(spark, store, registry=bad, request_id="r")
    log = V.latest_run_status(store.read("validation_run_log")).collect()
    assert [(r.run_id, r.status) for r in log] == [(1, "FAILED")]


def test_two_runs_at_once_have_two_numbers(spark, tmp_root):
    now, got = dt.datetime(2024, 1, 1), []
    threads = [threading.Thread(target=lambda: got.append(V.begin_run(spark, TableStore(spark, tmp_root), now)[0])) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3]


def test_scoped_history_is_pruned_and_finds_the_same(spark, loaded):
    store, out = loaded
    target = out["affected"]
    tables = {t: store.read(t) for t in ["survey_responses", "stores", "visits", "employees"]}
    pruned = V.scoped_history(tables, store.read("survey_days"), target)
    months = {r[0] for r in target.select(MONTH_COL).distinct().collect()}
    for name in ("visits", "survey_responses"):
        plan = pruned[name]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "visit_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
        left = {r[0] for r in pruned[name].select(MONTH_COL).distinct().collect()}
        assert left == months and len({r[0] for r in tables[name].select(MONTH_COL).distinct().collect()}) > len(months)
    strip = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert strip(V.evaluate_rules(pruned, V.REGISTERED_RULES, target)) == strip(V.evaluate_rules(tables, V.REGISTERED_RULES, target))


def test_a_week_reaches_months_of_other_visits(spark):
    """An answer given in the week of the target's, for a visit of another month, stays in the history."""
    survey = spark.createDataFrame([(1, "2024-01", dt.datetime(2024, 1, 31)), (2, "2024-02", dt.datetime(2024, 2, 2)), (3, "2024-06", dt.datetime(2024, 2, 4)),
                                    (4, "2024-03", dt.datetime(2024, 3, 9)), (5, "2024-02", None)], "visit_id bigint, visit_month string, response_datetime timestamp_ntz")
    days = survey.groupBy("visit_month").agg(F.to_date(F.min("response_datetime")).alias("first_day"), F.to_date(F.max("response_datetime")).alias("last_day"))
    target = spark.createDataFrame([(1, "2024-01")], "visit_id bigint, visit_month string")
    assert sorted(r[0] for r in rules.osa_history(survey, days, target, ["2024-01"]).collect()) == [1, 2, 3, 5]


def test_migration_once(spark, tmp_root):
    store = TableStore(spark, tmp_root)
    assert migration.run_migration(spark, store)["status"] == migration.CREATED
    assert store.read("validation_results").count() == 0 and store.read("validation_rules").count() == 0
    assert migration.run_migration(spark, store)["status"] == migration.UNCHANGED

    legacy = legacy_from_findings(catalog._ctx(spark, SF_SMALL).findings_run1)
    store = TableStore(spark, f"{tmp_root}-legacy")
    store.overwrite("validation_results", legacy)
    off = V.sync_rules(spark, None, dt.datetime(2023, 1, 1)).withColumn("is_active", F.lit(False))
    store.overwrite("validation_rules", off)
    with pytest.raises(ZeroDivisionError), store.transaction():
        migration.run_migration(spark, store)
        1 / 0
    assert "banner" in store.read("validation_results").columns  # nothing of it was published
    out = migration.run_migration(spark, store)
    n = legacy.count()
    assert out["status"] == "MIGRATED" and out["rows"] == n == store.read("validation_results").count() == store.read(out["backup"]).count()
    run = V.latest_run_status(store.read("validation_run_log")).collect()
    assert [(r.run_id, r.status, r.rules_executed, r.issues_found) for r in run] == [(1, "MIGRATED", 2, n)]
    assert {r.is_active for r in store.read("validation_rules").collect()} == {False}  # rules that are off stay off
    before = store.versions()
    assert migration.run_migration(spark, store)["status"] == migration.UNCHANGED and store.versions() == before


def test_feed_of_three_batches_and_a_killed_one(spark, tmp_root, monkeypatch):
    from shelfscan.sources.schema import EXPORT_HEADER
    from shelfscan.streaming import start_export_feed
    from test_export import raw_export

    src = events_source(spark, SF_SMALL)
    header = [f" {k.upper()} " for k in EXPORT_HEADER]
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(tmp_root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{tmp_root}/inbox"))
    for i in range(3):
        part = src.filter(F.col("src_ordinal") % 3 == i).limit(120)
        (raw_export(part).coalesce(1).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false")
            .option("ignoreTrailingWhiteSpace", "false").csv(f"{tmp_root}/tmp{i}"))
        made = [s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{tmp_root}/tmp{i}")) if s.getPath().getName().endswith(".csv")]
        fs.rename(made[0].getPath(), jvm.org.apache.hadoop.fs.Path(f"{tmp_root}/inbox/export_{i}.csv"))
    real, calls = pipeline.run_validation, []

    def killed_once(session, store, *args, **kwargs):
        calls.append(kwargs["request_id"])
        out = real(session, store, *args, **kwargs)
        if len(calls) == 2:
            raise RuntimeError("killed after the findings of the second batch")
        return out

    monkeypatch.setattr(pipeline, "run_validation", killed_once)
    start = lambda: start_export_feed(spark, f"{tmp_root}/inbox", f"{tmp_root}/store", header, max_files_per_trigger=1)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination(600)
    start().awaitTermination(600)
    store = TableStore(spark, f"{tmp_root}/store")
    assert sorted(r.batch_id for r in store.read("feed_batches").collect()) == [0, 1, 2]
    log = V.latest_run_status(store.read("validation_run_log")).collect()
    assert {(r.run_id, r.status, r.request_id.split("/")[1]) for r in log} == {(1, "SUCCESS", "0"), (2, "SUCCESS", "1"), (3, "SUCCESS", "2")}
    assert len(calls) == 4 and calls[1] == calls[2]
