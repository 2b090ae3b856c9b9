"""One delivery, end to end: base tables, task tables, survey fact.

Shape: read -> stage (prepared source, by columns) -> {dims, visits} merge ->
routed rows -> SOS / long task answers / wide task tables; survey fact.  All
tables are published together, in one version of the store; ids never reach
the driver.  Returns counts gathered with ``Observation`` during the writes (no
extra jobs).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..constants import SOS_TABLE
from ..operators import dims, pivot, routing, sos, survey
from ..session import compile_small
from ..sources.store import MONTH_COL, TableStore, replace_by_visit, with_visit_month

BASE_TABLES = ["employees", "stores", "products", "visits"]
#: Names the task tables that have no wide table, until a full refresh.
NARROW_TABLES = "narrow_tables"
#: Visits of the last delivery, with their months.
AFFECTED = "affected_visits"
#: First and last day of the answers of every month of visits: what a week can touch.
SURVEY_DAYS = "survey_days"
#: Tables that are written side by side.
LOADS_AT_ONCE = 4
#: Tables that a full refresh empties before it loads.
PAYLOAD = ["validation_results", "survey_quarantine", "survey_responses", "question_dictionary", NARROW_TABLES, SURVEY_DAYS]


def _count(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def run_etl(spark: SparkSession, source: DataFrame, store: TableStore, full_refresh: bool = False) -> dict:
    """Load one prepared delivery (see ``sources.export.prepare_source``) into ``store``.

    Nothing of it can be read before all of it: a run that is killed leaves the
    version before it, and is repeated as it is.  ``counts`` are the rows of
    each table's touched months after the load, ``delivered`` the rows that the
    delivery itself brought.  A task table with more questions than a table may
    have columns is not built wide (``narrow`` names it); its answers are in
    ``task_answers`` as all tables' are.  A wide table of earlier loads is
    dropped then, and stays away until a full refresh: built again from one
    delivery, it would lack the visits of others.
    """
    compile_small(spark)
    try:
        with store.transaction():
            out = _load(spark, source, store, full_refresh)
        store.vacuum()
        return out
    finally:
        store.clear_staging()


def _load(spark: SparkSession, source: DataFrame, store: TableStore, full_refresh: bool) -> dict:
    src = store.stage("source", source)  # read once, used by every sink below
    if full_refresh:
        for name in store.tables():
            if name in PAYLOAD or name in BASE_TABLES or name.startswith(pivot.TABLE_PREFIX):
                store.drop(name)
    old = {t: store.read(t) for t in BASE_TABLES if store.exists(t)}
    # the months of a delivery are few; named, they prune every scan of history
    months = sorted(r[0] for r in src.select(F.date_format("visit_date", "yyyy-MM").alias("m")).distinct().collect() if r[0])
    if "visits" in old:
        # merge only the months this delivery touches; other months stay as
        # they are, and new ids follow the largest of all months
        old["all_visits"] = old["visits"]
        old["visits"] = old["visits"].filter(F.col(MONTH_COL).isin(months)).drop(MONTH_COL)
    passed = store.stage("first-rows", dims.base_pass(src))
    base = dims.load_base_tables(passed, lambda df: store.stage("new-keys", df), old)

    counts: dict[str, int] = {}
    delivered_counts: dict[str, int] = {}
    written: dict[str, DataFrame] = {}
    for name in BASE_TABLES:
        df, observed = _count(with_visit_month(base[name]) if name == "visits" else base[name], name)
        written[name] = store.replace_partitions(name, df) if name == "visits" else store.overwrite(name, df)
        counts[name] = observed.get["rows"]
    _require_unique(written["visits"], "visit_id")  # nothing is published yet

    visits = written["visits"]
    keys = passed.filter(F.col("table") == "visits").select(*dims.VISIT_KEY)
    affected = store.overwrite(AFFECTED, visits.join(keys, dims.VISIT_KEY, "left_semi").select("visit_id", MONTH_COL))

    def load(name: str, rows: DataFrame) -> None:
        """Put the delivered rows, by visit, in the place of the visits' old ones."""
        placed, brought = _count(rows.join(affected, "visit_id"), f"{name}_delivered")
        _replace(store, name, placed, affected, months, counts)
        delivered_counts[name] = brought.get["rows"]

    # ---- task tables ----------------------------------------------------------
    # read by the dictionary, every task table and the SOS reshape
    tagged = store.stage("tagged", routing.tag_task_rows(src, visits, written["products"]))
    known = store.read("question_dictionary")
    new_dict = pivot.question_dictionary(tagged, known)
    if known is None:
        store.overwrite("question_dictionary", new_dict)
    else:
        store.append("question_dictionary", new_dict)
    dictionary = store.read("question_dictionary")

    loads = [("task_answers", pivot.all_task_answers(tagged)), (SOS_TABLE, sos.sos_blocks(tagged))]
    narrow: list[str] = []
    listed = store.read(NARROW_TABLES)
    before = set() if listed is None else {r["target_table"] for r in listed.collect()}  # one row per task table at most
    # tables of earlier loads as well: visits that come again may have no rows for them now
    routed = {r[0] for r in tagged.select("target_table").distinct().collect()}  # a row for each task table
    wide = {t for t in store.tables() if t.startswith(pivot.TABLE_PREFIX)}
    for table in sorted((routed | before | wide) - {SOS_TABLE, "task_answers"}):
        cols = None if table in before else pivot.dictionary_columns(spark, dictionary, table)
        if cols is None:
            narrow.append(table)
            if table not in before:
                store.append(NARROW_TABLES, spark.createDataFrame([(table,)], "target_table string"))
            store.drop(table)  # its rows would go stale
        else:
            loads.append((table, pivot.pivot_task_table(tagged, table, cols)))

    # ---- survey fact -----------------------------------------------------------
    lookup = dims.visit_lookup(visits, written["employees"], written["stores"])
    good, bad = survey.split_valid_questions(store.stage("survey", survey.build_survey(src, lookup)))
    loads += [("survey_responses", good), ("survey_quarantine", bad)]
    with ThreadPoolExecutor(LOADS_AT_ONCE) as pool:  # tables of their own: small ones do not wait for large ones
        list(pool.map(lambda job: load(*job), loads))
    days = store.read("survey_responses").filter(F.col(MONTH_COL).isin(months)).groupBy(MONTH_COL).agg(
        F.to_date(F.min("response_datetime")).alias("first_day"), F.to_date(F.max("response_datetime")).alias("last_day"))
    others = store.read(SURVEY_DAYS)
    store.overwrite(SURVEY_DAYS, days if others is None else days.unionByName(others.filter(~F.col(MONTH_COL).isin(months))))

    counts["rows"] = src.count()
    return {"counts": counts, "delivered": delivered_counts, "affected": affected, "narrow": narrow}


def _require_unique(df: DataFrame, key: str) -> None:
    """Refuse to publish a table in which an id stands for two rows."""
    twice = df.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][key]} stands for {twice[0]['count']} rows")


def _replace(store: TableStore, name: str, new_rows: DataFrame, affected: DataFrame, months: list[str], counts: dict) -> None:
    """Delete-then-insert by visit: every affected visit's rows are replaced,
    also in tables that receive no new rows for it."""
    # the new rows carry the table's full column set (the question dictionary
    # only grows), so the old table is read with that schema
    rows = replace_by_visit(store.read(name, schema=new_rows.schema), new_rows, affected, months)
    rows, obs = _count(rows, name)
    store.replace_partitions(name, rows, touched=[(m,) for m in months])
    counts[name] = obs.get["rows"]


def replace_visits(store: TableStore, name: str, new_rows: DataFrame, affected: DataFrame) -> DataFrame:
    """``replace_by_visit`` as a job of its own: the table's affected visits get
    ``new_rows`` (with ``visit_id`` and ``visit_month``) instead of theirs.

    ``affected`` has (visit_id, visit_month); its visits lose their rows also
    where ``new_rows`` has none for them.  Returns the table read back.
    """
    with store.transaction():
        months = [r[0] for r in affected.select(MONTH_COL).distinct().collect()]
        _replace(store, name, new_rows, affected, months, {})
    return store.read(name)
