"""Publishing by versions: what a killed run leaves, conflicts, life cycle of files; dense numbers."""

import pytest
from pyspark.sql import functions as F

from shelfscan.operators.numbering import dense_numbers
from shelfscan.plans import etl
from shelfscan.sources import events_source, split_deliveries
from shelfscan.sources.store import PublishConflict, TableStore
from conftest import SF_SMALL

T = "visit_id bigint, visit_month string, v string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), T)


def rows(df):
    return sorted(tuple(r) for r in df.select("visit_id", "visit_month", "v").collect())


def test_all_tables_of_a_transaction_or_none(spark, tmp_root):
    store = TableStore(spark, tmp_root)
    store.overwrite("a", frame(spark, (1, "2024-01", "x")), ["visit_month"])
    store.overwrite("b", frame(spark, (1, "2024-01", "x")))
    with pytest.raises(RuntimeError):
        with store.transaction():
            store.replace_partitions("a", frame(spark, (2, "2024-01", "y")))
            store.append("b", frame(spark, (2, "2024-01", "y")))
            assert rows(store.read("a")) == [(2, "2024-01", "y")]  # inside, changes are seen
            raise RuntimeError("killed between two tables")
    assert rows(store.read("a")) == rows(store.read("b")) == [(1, "2024-01", "x")]
    with store.transaction():
        store.replace_partitions("a", frame(spark, (2, "2024-02", "y")), touched=[("2024-01",)])
        store.drop("b")
        assert TableStore(spark, tmp_root).exists("b")  # others see the earlier version
    assert rows(store.read("a")) == [(2, "2024-02", "y")] and store.read("b") is None


def test_a_killed_load_leaves_the_version_before_it(spark, tmp_root, monkeypatch):
    morning, afternoon = split_deliveries(events_source(spark, SF_SMALL))
    store = TableStore(spark, tmp_root)
    etl.run_etl(spark, morning, store)
    tables = {t: store.read(t).count() for t in store.tables()}
    real = etl.sos.sos_blocks

    def kill(tagged):
        raise KeyboardInterrupt

    monkeypatch.setattr(etl.sos, "sos_blocks", kill)
    with pytest.raises(KeyboardInterrupt):
        etl.run_etl(spark, afternoon, store)
    assert {t: store.read(t).count() for t in store.tables()} == tables  # base tables were written, but not published
    monkeypatch.setattr(etl.sos, "sos_blocks", real)
    etl.run_etl(spark, afternoon, store)
    again, whole = TableStore(spark, f"{tmp_root}-again"), lambda s: {t: s.read(t).count() for t in s.tables()}
    for delivery in (morning, afternoon):
        etl.run_etl(spark, delivery, again)
    assert whole(store) == whole(again)


def test_two_publishers(spark, tmp_root):
    one, two = TableStore(spark, tmp_root), TableStore(spark, tmp_root)
    one.overwrite("a", frame(spark, (1, "m", "x")))
    with one.transaction():
        one.append("log", frame(spark, (1, "m", "one")))
        two.append("log", frame(spark, (2, "m", "two")))
        two.overwrite("other", frame(spark, (3, "m", "z")))
    assert rows(one.read("log")) == [(1, "m", "one"), (2, "m", "two")] and one.exists("other")
    with pytest.raises(PublishConflict):
        with one.transaction():
            one.overwrite("a", frame(spark, (4, "m", "one")))
            two.overwrite("a", frame(spark, (5, "m", "two")))
    assert rows(one.read("a")) == [(5, "m", "two")]
    with pytest.raises(PublishConflict):
        with one.transaction():
            one.append("log", frame(spark, (6, "m", "alone")), alone=True)
            two.append("log", frame(spark, (7, "m", "two")))
    assert 6 not in {r[0] for r in rows(one.read("log"))}


def test_columns_grow_and_partitions_prune(spark, tmp_root):
    store = TableStore(spark, tmp_root)
    store.overwrite("t", frame(spark, (1, "2024-01", "a"), (2, "2024-02", "b")), ["visit_month"])
    more = spark.createDataFrame([(3, "2024-03", "c", 7)], T + ", extra int")
    store.replace_partitions("t", more)
    got = store.read("t")
    assert {(r.visit_id, r.extra) for r in got.collect()} == {(1, None), (2, None), (3, 7)}
    plan = got.filter(F.col("visit_month") == "2024-02").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(visit_month" in plan and "ReadSchema: struct<v:string>" in plan
    empty = store.overwrite("none", frame(spark).limit(0), ["visit_month"])
    assert empty.count() == store.read("none").count() == 0 and store.read("none").columns == ["visit_id", "v", "visit_month"]


def test_vacuum_keeps_what_kept_versions_name(spark, tmp_root):
    store = TableStore(spark, tmp_root)
    for i in range(6):
        store.replace_partitions("t", frame(spark, (i, f"2024-0{1 + i % 2}", "x")))
    abandoned = store._write("t", frame(spark, (9, "2024-09", "never")), ["visit_month"])["folders"]
    before = rows(store.read("t"))
    gone = store.vacuum(keep=2)
    assert rows(store.read("t")) == before == [(4, "2024-01", "x"), (5, "2024-02", "x")]
    assert len(store.versions()) == 2 and len(gone) == 3 and not any("2024-09" in g for g in gone)
    assert store.vacuum(keep=1, abandoned_after=-60) and rows(store.read("t")) == before
    assert not any(s.getPath().getName() == abandoned[0].split("/")[0] for s in store._list(f"{tmp_root}/data/t"))


def test_replaced_visits_are_read_back(spark, tmp_root):
    store = TableStore(spark, tmp_root)
    store.overwrite("t", frame(spark, (1, "2024-01", "a"), (2, "2024-02", "b"), (3, "2024-02", "c")), ["visit_month"])
    affected = spark.createDataFrame([(1, "2024-01"), (3, "2024-02"), (4, "2024-03")], "visit_id bigint, visit_month string")
    new = frame(spark, (3, "2024-02", "new"), (4, "2024-03", "d"))
    want = [(2, "2024-02", "b"), (3, "2024-02", "new"), (4, "2024-03", "d")]
    for _ in range(2):
        assert rows(etl.replace_visits(store, "t", new, affected)) == want


@pytest.mark.parametrize("plain", [True, False])
def test_dense_numbers_over_many_files(spark, tmp_root, monkeypatch, plain):
    """Ids grow by the number of new keys, however far apart their ordinals are; by a window or over ranges."""
    from shelfscan.operators import numbering

    monkeypatch.setattr(numbering, "PLAIN_ROWS", 1 << 20 if plain else -1)
    store = TableStore(spark, tmp_root)
    spread = spark.range(10_000).select((F.col("id") * (1 << 40) + 5).alias("o"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g")).orderBy(F.rand(1))
    got = dense_numbers(spread, "g", "o", "number", lambda df: store.stage("n", df)).collect()
    for g in "ab":
        mine = sorted((r["o"], r["number"]) for r in got if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert dense_numbers(spread.limit(0), "g", "o", "number", lambda df: store.stage("n", df)).count() == 0


@pytest.mark.parametrize("plain", [True, False])
def test_ids_stay_dense_over_loads(spark, tmp_root, monkeypatch, plain):
    from shelfscan.operators import numbering

    monkeypatch.setattr(numbering, "PLAIN_ROWS", 1 << 20 if plain else -1)
    morning, afternoon = split_deliveries(events_source(spark, SF_SMALL))
    store = TableStore(spark, tmp_root)
    for delivery in (morning, afternoon, afternoon):
        shifted = delivery.withColumn("src_ordinal", F.col("src_ordinal") * (1 << 40))
        etl.run_etl(spark, shifted, store)
        for name, key in etl.dims.ID_COLS.items():
            found = store.read(name).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("top"), F.count_distinct(key).alias("ids")).first()
            assert found.n == found.top == found.ids
