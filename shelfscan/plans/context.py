"""Per-session context over the test tables: one delivery or two deliveries.

Frames that several branches of a query read are written once, as Parquet in
the shared checkpoint folder, when they are first asked for; all others are
lazy.  ``close`` removes what was written.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dims, pivot, routing, rules, survey
from ..session import checkpoint_dir
from ..sources.fixture import events_source, split_deliveries
from ..sources.store import TableStore


class FixtureContext:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._store = TableStore(spark, f"{checkpoint_dir(spark)}/context")

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a frame that several branches read, and read it back.

        Later plans start from its columns: their scans are pruned to what they
        use, filters reach the files, the lineage is short for the optimizer
        and survives lost executors.
        """
        return self._store.stage("context", df)

    def new_store(self, name: str) -> TableStore:
        """An empty store of its own in the shared folder."""
        return TableStore(self.spark, f"{checkpoint_dir(self.spark)}/stores/{name}-{uuid.uuid4().hex}")

    def close(self) -> None:
        self._store.clear_staging()

    # ---- single delivery (the whole table loaded once) ---------------------
    @cached_property
    def src(self) -> DataFrame:
        # the prepared source is read by every base table, the routed rows and
        # the survey fact: read it once
        return self.keep(events_source(self.spark, self.sf_dir))

    @cached_property
    def base(self) -> dict[str, DataFrame]:
        return dims.load_base_tables(self.keep(dims.base_pass(self.src)), self.keep)

    @property
    def employees(self) -> DataFrame:
        return self.base["employees"]

    @property
    def stores(self) -> DataFrame:
        return self.base["stores"]

    @property
    def products(self) -> DataFrame:
        return self.base["products"]

    @property
    def visits(self) -> DataFrame:
        return self.base["visits"]

    @cached_property
    def lookup(self) -> DataFrame:
        return dims.visit_lookup(self.visits, self.employees, self.stores)

    @cached_property
    def survey(self) -> DataFrame:
        return self.keep(survey.build_survey(self.src, self.lookup))

    @cached_property
    def tagged(self) -> DataFrame:
        # read by the dictionary, every task table and the SOS reshape
        return self.keep(routing.tag_task_rows(self.src, self.visits, self.products))

    @cached_property
    def dictionary(self) -> DataFrame:
        return pivot.question_dictionary(self.tagged)

    def wide(self, table: str) -> DataFrame:
        if not hasattr(self, "_wide"):
            self._wide = {}
        if table not in self._wide:
            cols = pivot.dictionary_columns(self.spark, self.dictionary, table)
            self._wide[table] = pivot.pivot_task_table(self.tagged, table, cols)
        return self._wide[table]

    @cached_property
    def gps_rows(self) -> DataFrame:
        return rules.visit_gps(self.visits, self.employees, self.stores)

    @cached_property
    def osa_found(self) -> DataFrame:
        return rules.osa_unusual_non(self.survey, self.stores)

    @cached_property
    def gps_found(self) -> DataFrame:
        return rules.gps_inconsistent(self.gps_rows)

    # ---- two deliveries: morning load, then afternoon load -------------------
    @cached_property
    def deliveries(self) -> tuple[DataFrame, DataFrame]:
        return split_deliveries(self.src)

    @cached_property
    def pass1(self) -> DataFrame:
        return self.keep(dims.base_pass(self.deliveries[0]))

    @cached_property
    def pass2(self) -> DataFrame:
        return self.keep(dims.base_pass(self.deliveries[1]))

    @cached_property
    def load1(self) -> dict[str, DataFrame]:
        return dims.load_base_tables(self.pass1, self.keep)

    @cached_property
    def load2(self) -> dict[str, DataFrame]:
        return dims.load_base_tables(self.pass2, self.keep, self.load1)

    @cached_property
    def affected(self) -> DataFrame:
        """Visits delivered by the afternoon load (ids after the merge)."""
        return dims.affected_visits(self.load2["visits"], dims.build_visits(self.deliveries[1], self.pass2))

    def survey_of(self, delivery: DataFrame, load: dict[str, DataFrame]) -> DataFrame:
        lk = dims.visit_lookup(load["visits"], load["employees"], load["stores"])
        return survey.build_survey(delivery, lk)

    # ---- validation runs ------------------------------------------------------
    @cached_property
    def findings_run1(self) -> DataFrame:
        """Full-scope run over the whole history (run 1)."""
        f = rules.osa_findings(self.osa_found).unionByName(rules.gps_findings(self.gps_found))
        return f.withColumn("run_id", F.lit(1).cast("bigint"))

    @cached_property
    def findings_run2(self) -> DataFrame:
        """Daily run scoped to the afternoon delivery's visits (run 2)."""
        target = self.affected_single
        f = (rules.osa_findings(rules.osa_unusual_non(self.survey, self.stores, target))
             .unionByName(rules.gps_findings(rules.gps_inconsistent(self.gps_rows, target))))
        return f.withColumn("run_id", F.lit(2).cast("bigint"))

    @cached_property
    def affected_single(self) -> DataFrame:
        """Afternoon-delivered visits, with the single-load visit ids."""
        delivered = self.deliveries[1].select("visit_date", dims.clean_text("employee_code").alias("employee_code"),
                                              dims.clean_text("store_code").alias("store_code"))
        return self.visits.join(delivered, dims.VISIT_KEY, "left_semi").select("visit_id")

    @cached_property
    def findings(self) -> DataFrame:
        return self.findings_run1.unionByName(self.findings_run2)
