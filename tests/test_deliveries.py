"""Jobs over several deliveries: months, empty tables, column limits, restarts of the feed."""

import datetime as dt

from pyspark.sql import functions as F

from shelfscan.constants import TASK_TABLE_MAP, TITLE_TABLE_MAP
from shelfscan.plans import pipeline
from shelfscan.plans.etl import run_etl
from shelfscan.sources import events_source
from shelfscan.sources.store import MONTH_COL, TableStore
from conftest import SF_SMALL


def months_of(spark, n):
    """The fixture's rows moved into n different months, and their first days."""
    src = events_source(spark, SF_SMALL)
    begin = src.agg(F.trunc(F.min("visit_date"), "month").alias("d")).first().d
    moved = []
    for k in range(n):
        part = src.filter(F.pmod("src_ordinal", F.lit(n)) == k)
        day = F.add_months(F.lit(begin), 3 * k)
        shifted = part.withColumn("visit_date", F.date_add(day, F.pmod(F.datediff("visit_date", F.lit(begin)), F.lit(28)))) \
                      .withColumn("year", F.year("visit_date").cast(src.schema["year"].dataType)) \
                      .withColumn("month", F.month("visit_date").cast(src.schema["month"].dataType))
        moved.append(shifted.select(*src.columns))
    return moved


def snapshot(store, months):
    out = {}
    for name in [*TASK_TABLE_MAP.values(), *TITLE_TABLE_MAP.values(), "task_answers", "survey_responses", "survey_quarantine", "visits"]:
        df = store.read(name)
        rows = [] if df is None else df.filter(F.col(MONTH_COL).isin(months)).collect()
        out[name] = sorted((repr(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in rows))
    return out


def test_second_month_leaves_the_first_alone(spark, tmp_root):
    first, second = months_of(spark, 2)
    store = TableStore(spark, f"{tmp_root}/store")
    run_etl(spark, first, store)
    months = [r[0] for r in store.read("visits").select(MONTH_COL).distinct().collect()]
    before = snapshot(store, months)
    assert before["survey_responses"] and before["task_answers"]
    out = run_etl(spark, second, store)
    assert snapshot(store, months) == before
    visits = store.read("visits")
    assert visits.count() == visits.select("visit_id").distinct().count() > len(before["visits"])
    assert out["delivered"]["survey_responses"] > 0 and out["counts"]["rows"] == second.count()
    again = snapshot(store, months)
    whole = {n: store.read(n).count() for n in ("survey_responses", "task_answers", "visits")}
    quarantined = store.read("survey_quarantine").count() if store.read("survey_quarantine") is not None else 0
    run_etl(spark, second, store)
    assert snapshot(store, months) == again and {n: store.read(n).count() for n in whole} == whole
    if quarantined:
        assert store.read("survey_quarantine").count() == quarantined


def test_delivery_without_rows_for_most_tables(spark, tmp_root):
    src = events_source(spark, SF_SMALL)
    store = TableStore(spark, f"{tmp_root}/store")
    checkins = src.filter(F.lower("title").contains("gps") | F.lower("title").contains("check"))
    some = checkins if checkins.count() else src.limit(1)
    out = run_etl(spark, some, store)
    assert store.read("visits").count() == out["counts"]["visits"] > 0
    empty = run_etl(spark, src.limit(0), store)
    assert empty["delivered"]["survey_responses"] == 0 and empty["counts"]["rows"] == 0


def test_more_questions_than_columns(spark, tmp_root):
    store = TableStore(spark, f"{tmp_root}/store")
    old = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "1")
    try:
        out = run_etl(spark, events_source(spark, SF_SMALL), store)
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", old)
    assert out["narrow"] and store.read("task_answers").filter(F.col("target_table").isin(out["narrow"])).count() > 0
    assert out["counts"]["survey_responses"] > 0


def test_later_load_with_more_questions_than_columns(spark, tmp_root):
    first, second = months_of(spark, 2)
    store = TableStore(spark, f"{tmp_root}/store")
    wide = run_etl(spark, first, store)
    assert not wide["narrow"] and store.read("narrow_tables") is None
    old = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "1")
    try:
        out = run_etl(spark, second, store)
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", old)
    assert out["narrow"] and not any(store.exists(t) for t in out["narrow"])
    answers = {t: store.read("task_answers").filter(F.col("target_table") == t).count() for t in out["narrow"]}
    # a wide table of the third delivery's visits alone would look whole
    again = run_etl(spark, second, store)
    assert again["narrow"] == out["narrow"] and not any(store.exists(t) for t in again["narrow"])
    assert {t: store.read("task_answers").filter(F.col("target_table") == t).count() for t in answers} == answers
    full = run_etl(spark, second, store, full_refresh=True)
    assert not full["narrow"] and store.read("narrow_tables") is None
    assert all(store.read(t).count() > 0 for t in out["narrow"] if answers[t])


def test_ledger_tells_feeds_apart(spark, tmp_root):
    from shelfscan.streaming import _state

    store = TableStore(spark, f"{tmp_root}/store")
    assert not _state.batch_done(store, "a", 0)
    _state.mark_done(spark, store, "a", 0)
    assert _state.batch_done(store, "a", 0) and not _state.batch_done(store, "b", 0) and not _state.batch_done(store, "a", 1)


def test_feed_goes_on_after_a_restart(spark, tmp_root):
    from shelfscan.sources.schema import EXPORT_HEADER
    from shelfscan.streaming import start_export_feed
    from test_export import raw_export

    parts = [p.limit(60) for p in months_of(spark, 2)]
    header = [f" {k.upper()} " for k in EXPORT_HEADER]
    for part in parts:  # a new query over the same folder each time, as after a restart
        (raw_export(part).coalesce(1).write.mode("append").option("header", "true")
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{tmp_root}/inbox"))
        q = start_export_feed(spark, f"{tmp_root}/inbox", f"{tmp_root}/store", header, mode=pipeline.BACKFILL)
        q.awaitTermination(600)
    store = TableStore(spark, f"{tmp_root}/store")
    ledger = store.read("feed_batches").collect()
    assert sorted(r.batch_id for r in ledger) == [0, 1] and len({r.feed for r in ledger}) == 1
    assert store.read("visits").select(MONTH_COL).distinct().count() >= 2
