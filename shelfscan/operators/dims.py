"""Dimension and visit tables: build from a delivery, merge into history.

Natural keys (codes, visit date + codes) are the join keys everywhere.
Surrogate ids exist for output parity: an existing key keeps its id; new keys
are numbered densely after the largest id, in the order of their first rows,
without a ranking in one task (see ``numbering``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import clean_text, map_link
from .numbering import dense_numbers

EMPLOYEE_COLS = ["employee_code", "username"]
STORE_COLS = ["store_code", "store_name", "store_city", "store_state", "store_region", "store_format"]
PRODUCT_COLS = ["product_code", "barcode", "product_description", "brand", "category", "sub_category"]
VISIT_KEY = ["visit_date", "employee_code", "store_code"]
VISIT_ATTRS = ["year", "month", "latitude", "longitude", "map_link"]

EMPLOYEES_SCHEMA = T.StructType([T.StructField("employee_id", T.LongType())]
                                + [T.StructField(c, T.StringType()) for c in EMPLOYEE_COLS])
STORES_SCHEMA = T.StructType([T.StructField("store_id", T.LongType())]
                             + [T.StructField(c, T.StringType()) for c in STORE_COLS])
PRODUCTS_SCHEMA = T.StructType([T.StructField("product_id", T.LongType())]
                               + [T.StructField(c, T.StringType()) for c in PRODUCT_COLS])
VISITS_SCHEMA = T.StructType([
    T.StructField("visit_id", T.LongType()),
    T.StructField("visit_date", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.StringType()),
    T.StructField("employee_id", T.LongType()),
    T.StructField("store_id", T.LongType()),
    T.StructField("employee_code", T.StringType()),
    T.StructField("store_code", T.StringType()),
    T.StructField("latitude", T.DecimalType(10, 6)),
    T.StructField("longitude", T.DecimalType(10, 6)),
    T.StructField("map_link", T.StringType()),
])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- builders --
#
# The first row of every key is found on the row's ordinal alone: one hash
# aggregate over GROUPING SETS whose rows are key parts and a number.  The
# attributes of the first rows, which are few, are then fetched by their
# ordinals: those of dimensions, where Spark broadcasts the first rows, apart
# from those of visits, which are narrow.  The result is written once and all
# base tables read it.

KEY_COLS = ["visit_date", "employee_code", "store_code", "product_code"]
GROUP_SETS = {
    "employees": ["employee_code"],
    "stores": ["store_code"],
    "products": ["product_code"],
    "visits": VISIT_KEY,
}
#: Attributes as the delivery has them (the map link is made from the position).
TABLE_ATTRS = {
    "employees": EMPLOYEE_COLS[1:],
    "stores": STORE_COLS[1:],
    "products": PRODUCT_COLS[1:],
    "visits": ["year", "month", "latitude", "longitude"],
}


def grouping_id_of(grouped: list[str]) -> int:
    """Spark's grouping_id: one bit per key column, 1 = column not grouped."""
    gid = 0
    for c in KEY_COLS:
        gid = (gid << 1) | (0 if c in grouped else 1)
    return gid


def _keys(src: DataFrame, names: list[str]) -> DataFrame:
    return src.select("src_ordinal", *[c if c == "visit_date" else clean_text(c).alias(c) for c in names])


ATTRS = [a for attrs in TABLE_ATTRS.values() for a in attrs]


def _attributes(first: DataFrame, src: DataFrame, tables: list[str]) -> DataFrame:
    """First rows of some tables' keys with the attributes of these tables, cleaned; others are null."""
    own = [a for t in tables for a in TABLE_ATTRS[t]]
    rows = first.filter(F.col("table").isin(tables)).join(src.select(F.col("src_ordinal").alias("first_ordinal"), *own), "first_ordinal")
    exact = {"year": F.col("year"), "latitude": F.col("latitude").cast("decimal(10,6)"), "longitude": F.col("longitude").cast("decimal(10,6)")}
    types = {"year": "int", "latitude": "decimal(10,6)", "longitude": "decimal(10,6)"}
    return rows.select("table", *KEY_COLS, "first_ordinal", *[
        (exact.get(a, clean_text(a)) if a in own else F.lit(None).cast(types.get(a, "string"))).alias(a) for a in ATTRS])


def base_pass(src: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """(table, key parts, first_ordinal, attributes): the first row of every key of the base tables.

    Keys with a null part are left out.  Key parts and attributes that a table
    does not have are null.
    """
    tables = list(tables or GROUP_SETS)
    found = _keys(src, KEY_COLS).groupingSets([GROUP_SETS[t] for t in tables], *KEY_COLS).agg(
        F.grouping_id().alias("_gid"), F.min("src_ordinal").alias("first_ordinal"))
    table, whole = F.lit(None).cast("string"), F.lit(False)
    for name in tables:
        here = F.col("_gid") == grouping_id_of(GROUP_SETS[name])
        table = F.when(here, F.lit(name)).otherwise(table)
        for k in GROUP_SETS[name]:
            here = here & F.col(k).isNotNull()
        whole = whole | here
    first = found.filter(whole).select(*KEY_COLS, "first_ordinal", table.alias("table"))
    parts = [p for p in ([t for t in tables if t != "visits"], [t for t in tables if t == "visits"]) if p]
    return reduce(DataFrame.unionByName, [_attributes(first, src, p) for p in parts])


def _build(src: DataFrame, name: str, passed: DataFrame | None, also: tuple = ()) -> DataFrame:
    """First rows of one table's keys with their cleaned attributes."""
    rows = (base_pass(src, [name]) if passed is None else passed).filter(F.col("table") == name)
    if name == "visits":
        rows = rows.withColumn("map_link", map_link(F.col("latitude"), F.col("longitude")))
    attrs = VISIT_ATTRS if name == "visits" else TABLE_ATTRS[name]
    return rows.select(*GROUP_SETS[name], *attrs, "first_ordinal", *also)


def build_employees(src: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """Clean code / name, drop null code, first row per code."""
    return _build(src, "employees", passed)


def build_stores(src: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    return _build(src, "stores", passed)


def build_products(src: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    return _build(src, "products", passed)


def build_visits(src: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """One row per (visit_date, employee_code, store_code), first row wins; null key parts dropped."""
    return _build(src, "visits", passed)


# ------------------------------------------------------------------ merges --

ID_COLS = {"employees": "employee_id", "stores": "store_id", "products": "product_id", "visits": "visit_id"}


def next_id_base(old: DataFrame, id_col: str):
    """Scalar sub-query: largest id already allocated (0 for an empty table)."""
    return old.select(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()


def numbered_keys(passed: DataFrame, old: dict, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``passed`` with ``number``: dense from 1 for the keys that their table does not have yet, in the order of
    their first rows; null for the others.

    All tables' new keys are numbered in one pass.  ``old`` holds the tables
    (or the part of them that a delivery can match) by name; a table that is
    not there has no keys.
    """
    if not any(old.get(name) is not None for name in GROUP_SETS):  # all are new
        return dense_numbers(passed, "table", "first_ordinal", "number", stage)
    parts = []
    for name, keys in GROUP_SETS.items():
        rows = passed.filter(F.col("table") == name)
        if old.get(name) is None:
            rows = rows.withColumn("group", F.lit(f"{name} new"))
        else:
            known = old[name].select(*keys, F.lit(True).alias("_known"))
            rows = rows.join(known, keys, "left").withColumn("group", F.when(F.col("_known"), F.lit(f"{name} known")).otherwise(F.lit(f"{name} new"))).drop("_known")
        parts.append(rows.select("group", *passed.columns))
    rows = dense_numbers(reduce(DataFrame.union, parts), "group", "first_ordinal", "place", stage)
    return rows.withColumn("number", F.when(F.endswith("group", F.lit("new")), F.col("place"))).drop("group", "place")


def merge_dimension(old: DataFrame | None, new: DataFrame, key: list[str] | str, id_col: str,
                    attrs: list[str], allocated: DataFrame | None = None) -> DataFrame:
    """Upsert ``new`` into ``old`` by natural key.

    Attributes of a delivered key are overwritten, also with null; keys not in
    the delivery are kept untouched.  ``number`` of ``new`` numbers the keys
    that are not in ``old``.  ``old=None`` is a first load into an empty table:
    ids start at 1.  Where ``old`` is a part of a table, ``allocated`` is the
    whole of it: new ids follow the largest of these.
    """
    key = [key] if isinstance(key, str) else list(key)
    if old is None:
        return new.select(*key, F.col("number").cast("bigint").alias(id_col), *attrs)
    base = next_id_base(old if allocated is None else allocated, id_col)
    o = old.select(*key, id_col, *attrs)
    n = new.select(*key, *attrs, "number", F.lit(True).alias("_new"))
    j = o.alias("o").join(n.alias("n"), key, "full_outer")
    is_new = F.col("n._new").isNotNull()
    cols = [F.col(k) for k in key]
    cols.append(F.coalesce(F.col(f"o.{id_col}"), base + F.col("n.number")).cast("bigint").alias(id_col))
    cols += [F.when(is_new, F.col(f"n.{a}")).otherwise(F.col(f"o.{a}")).alias(a) for a in attrs]
    return j.select(*cols)


def merge_employees(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return merge_dimension(old, new, "employee_code", "employee_id", ["username"]) \
        .select(*EMPLOYEES_SCHEMA.names)


def merge_stores(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return merge_dimension(old, new, "store_code", "store_id", STORE_COLS[1:]).select(*STORES_SCHEMA.names)


def merge_products(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return merge_dimension(old, new, "product_code", "product_id", PRODUCT_COLS[1:]) \
        .select(*PRODUCTS_SCHEMA.names)


def attach_dim_ids(visits: DataFrame, employees: DataFrame, stores: DataFrame) -> DataFrame:
    """Visits whose employee and store are known (inner joins; a miss skips the visit)."""
    return (visits.join(employees.select("employee_code", "employee_id"), "employee_code")
                  .join(stores.select("store_code", "store_id"), "store_code"))


def merge_visits(old: DataFrame | None, new: DataFrame, employees: DataFrame, stores: DataFrame,
                 allocated: DataFrame | None = None) -> DataFrame:
    """Upsert visits by (visit_date, employee, store); year, month, GPS and link are updated."""
    new = attach_dim_ids(new, employees, stores)
    attrs = ["year", "month", "employee_id", "store_id", "latitude", "longitude", "map_link"]
    return merge_dimension(old, new, VISIT_KEY, "visit_id", attrs, allocated).select(*VISITS_SCHEMA.names)


def affected_visits(merged_visits: DataFrame, delivered: DataFrame) -> DataFrame:
    """Ids of every visit present in the delivery (new or updated)."""
    return merged_visits.join(delivered.select(*VISIT_KEY), VISIT_KEY, "left_semi").select("visit_id")


def visit_lookup(visits: DataFrame, employees: DataFrame, stores: DataFrame) -> DataFrame:
    """visits x employees x stores on surrogate ids, back to natural codes."""
    return (visits.select("visit_id", "visit_date", "employee_id", "store_id")
            .join(employees.select("employee_id", "employee_code"), "employee_id")
            .join(stores.select("store_id", "store_code"), "store_id")
            .select("visit_id", "visit_date", "employee_code", "store_code"))


def load_base_tables(passed: DataFrame, stage: Callable[[DataFrame], DataFrame],
                     old: dict | None = None) -> dict[str, DataFrame]:
    """Merge all four base tables for one delivery.

    ``passed`` is the written ``base_pass`` of it, and ``stage`` writes a frame
    and reads it back (for the numbers of new keys).  ``old`` has the tables so
    far; for visits that may be the months which the delivery touches, with the
    whole table as ``all_visits``.
    """
    old = old or {}
    numbered = numbered_keys(passed, old, stage)
    new = {name: _build(None, name, numbered, ("number",)) for name in GROUP_SETS}
    emp = merge_employees(old.get("employees"), new["employees"])
    sto = merge_stores(old.get("stores"), new["stores"])
    pro = merge_products(old.get("products"), new["products"])
    vis = merge_visits(old.get("visits"), new["visits"], emp, sto, old.get("all_visits"))
    return {"employees": emp, "stores": sto, "products": pro, "visits": vis}
