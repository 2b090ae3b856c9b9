"""End to end on the small fixture: load twice, reload, validate, compare to the catalog."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfscan.plans import catalog, pipeline
from shelfscan.plans.validation import latest_run_status, run_validation
from shelfscan.sources.fixture import events_source, split_deliveries
from shelfscan.sources.store import TableStore


def rows(df, drop=("visit_month",)):
    return sorted((tuple(r) for r in df.drop(*drop).collect()), key=repr)


def test_two_loads_reload_and_validation(spark, tmp_root):
    store = TableStore(spark, tmp_root)
    src = events_source(spark, SF_SMALL)
    morning, afternoon = split_deliveries(src)

    first = pipeline.run(spark, morning, store, mode=pipeline.BACKFILL)
    assert first["validation"] is None
    second = pipeline.run(spark, afternoon, store, mode=pipeline.DAILY)
    assert second["validation"]["status"] == "SUCCESS"

    # the stored tables equal the catalog's two-delivery queries
    cols = catalog.QUERIES["merge_visits"](spark, SF_SMALL).columns
    assert rows(store.read("visits").select(*cols)) == rows(catalog.QUERIES["merge_visits"](spark, SF_SMALL))
    survey = store.read("survey_responses")
    exp = catalog.QUERIES["replace_by_visit"](spark, SF_SMALL)
    # null questions go to the quarantine table, not to the fact
    assert rows(survey.select(*exp.columns)) == rows(exp.filter(F.col("question").isNotNull()))
    assert store.read("survey_quarantine").filter(F.col("question").isNotNull()).count() == 0
    emp = store.read("employees")
    assert rows(emp) == rows(catalog.QUERIES["merge_employees"](spark, SF_SMALL))

    # reloading the same delivery changes no table (delete-then-insert by visit)
    before = {t: rows(store.read(t, merge_schema=True)) for t in
              ["visits", "survey_responses", "task_sos", "task_location_checkin", "task_osa_pack_coc_mh"]}
    again = pipeline.run(spark, afternoon, store, mode=pipeline.DAILY)
    after = {t: rows(store.read(t, merge_schema=True)) for t in before}
    assert before == after
    # findings are appended per run: same findings, new run id
    res = store.read("validation_results")
    per_run = {r.run_id: r.n for r in res.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per_run[second["validation"]["run_id"]] == per_run[again["validation"]["run_id"]]

    # a scoped run's findings = the full run's findings limited to the target visits
    target = store.read("visits").join(afternoon.select("visit_date").distinct(), "visit_date", "left_semi").select("visit_id")
    scoped = run_validation(spark, store, target=target)
    full = run_validation(spark, store)
    f_all = store.read("validation_results").filter(F.col("run_id") == full["run_id"])
    f_in = f_all.join(target, "visit_id", "left_semi").select(*f_all.columns).drop("detected_at", "run_id")
    s = rows(store.read("validation_results").filter(F.col("run_id") == scoped["run_id"]).drop("detected_at", "run_id"))
    assert s == rows(f_in)

    log = latest_run_status(store.read("validation_run_log"))
    assert {r.status for r in log.collect()} == {"SUCCESS"}
    assert log.count() == 4

    # an empty target is no work
    empty = run_validation(spark, store, target=target.limit(0))
    assert empty["results"] == {}
