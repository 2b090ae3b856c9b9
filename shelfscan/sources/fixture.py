"""Test-data adapter: ``events`` x ``nation`` x ``region`` -> prepared source rows.

One event is one answered question; ``event_id`` is unique and is the row
order.  The expressions below are the fixture definition shared with the
DuckDB oracle (same SQL text in both engines), so both sides see identical
input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .schema import SOURCE_SCHEMA

# FIXED VALUES: fixture definition (one SQL expression per source column).
FIXTURE_COLUMNS = {
    "src_ordinal": "e.event_id",
    "responsedate": "e.ts",
    "visit_date": "CAST(e.ts AS DATE)",
    "year": "year(e.ts)",
    "month": "CAST(month(e.ts) AS VARCHAR(2))",
    "employee_code": "concat('E', CAST(e.user_id % 10 AS VARCHAR(10)))",
    "username": "CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE concat(' user v', CAST(e.event_id % 3 AS VARCHAR(1))) END",
    "store_code": "concat('S', CAST(e.user_id % 20 AS VARCHAR(10)))",
    "store_name": (
        "CASE WHEN e.user_id % 20 < 5  THEN 'Marjane Market'    WHEN e.user_id % 20 < 8  THEN 'ACIMA' "
        "WHEN e.user_id % 20 < 11 THEN 'Marjane'           WHEN e.user_id % 20 < 14 THEN ' Carrefour Market' "
        "WHEN e.user_id % 20 < 16 THEN 'Carrefour'         WHEN e.user_id % 20 < 17 THEN 'Attacadao' "
        "WHEN e.user_id % 20 < 18 THEN 'Aswak Assalam'     ELSE 'Epicerie' END"),
    "store_format": (
        "CASE WHEN e.user_id % 20 = 19 THEN ' Grocery' WHEN e.user_id % 20 = 7 THEN 'ICE CREAM' "
        "WHEN e.user_id % 20 = 3 THEN NULL ELSE 'MODERN TRADE' END"),
    "store_city": "n.n_name",
    "store_region": "r.r_name",
    "product_code": (
        "CASE WHEN e.event_id % 20 BETWEEN 4 AND 13 OR e.event_id % 100 = 43 "
        "THEN CASE WHEN e.event_id % 40 < 20 THEN 'P0' ELSE 'P1' END END"),
    "task": (
        "CASE WHEN e.event_id % 100 = 1 THEN 'AUDIT' WHEN e.event_id % 100 = 21 THEN 'Bac glace' WHEN e.event_id % 100 = 41 THEN NULL "
        "WHEN e.event_id % 20 < 2 THEN ' LOCATION CHECK IN ' WHEN e.event_id % 20 = 2 THEN 'CALLCYCLE DEVIATION' "
        "WHEN e.event_id % 100 = 3 THEN 'QUALITY' WHEN e.event_id % 100 = 23 THEN 'LOCATION CHECK OUT' ELSE 'AUDIT' END"),
    "title": (
        "CASE WHEN e.event_id % 100 IN (1, 21) THEN 'Secondary placement' WHEN e.event_id % 100 = 43 THEN 'Prix promo' "
        "WHEN e.event_id % 100 = 63 THEN 'Temperature' WHEN e.event_id % 100 = 83 THEN 'Primary Shelf Placement' "
        "WHEN e.event_id % 20 BETWEEN 4 AND 13 THEN 'Osa audit' WHEN e.event_id % 20 >= 14 THEN 'Sos audit' END"),
    "question": (
        "CASE WHEN e.event_id % 100 = 61 THEN NULL "
        "WHEN e.event_id % 20 = 2 THEN 'Callcycle deviation' WHEN e.event_id % 20 BETWEEN 4 AND 13 THEN 'Produit disponible ?' "
        "WHEN e.event_id % 20 = 14 THEN 'TOTAL lineaire' WHEN e.event_id % 20 IN (15, 16, 17) THEN concat('Marque ', e.event_type) "
        "WHEN e.event_id % 20 >= 18 THEN 'Total UNILEVER SOS' ELSE concat('Photo ', e.event_type) END"),
    "response": (
        "CASE WHEN e.event_id % 20 = 2 THEN CASE WHEN e.event_id % 3 = 0 THEN 'Oui' ELSE 'Non' END "
        "WHEN e.event_id % 20 BETWEEN 4 AND 13 THEN CASE WHEN e.event_id % 11 = 0 THEN 'Non' ELSE 'Oui' END "
        "WHEN e.event_id % 20 = 18 THEN concat('$ ', CAST(e.event_id % 90 AS VARCHAR(10))) "
        "WHEN e.event_id % 13 = 0 THEN '  ' ELSE CAST(e.event_id % 50 AS VARCHAR(10)) END"),
    "latitude": (
        "CASE WHEN e.event_id % 59 = 0 THEN NULL WHEN e.event_id % 53 = 0 THEN 0.0 "
        "ELSE CAST(33.5 + (e.user_id % 20) * 0.01 + ((e.event_id * 7919) % 1000) / 1000000.0 "
        "+ CASE WHEN e.event_id % 41 = 0 THEN 0.03 WHEN e.event_id % 37 = 0 THEN 0.015 ELSE 0 END AS DECIMAL(10,6)) END"),
    "longitude": "CASE WHEN e.event_id % 59 = 0 THEN NULL ELSE CAST(-7.6 - (e.user_id % 20) * 0.01 AS DECIMAL(10,6)) END",
}

FIXTURE_FROM = (
    "FROM events e\n"
    "JOIN nation n ON n.n_nationkey = e.user_id % 20\n"
    "JOIN region r ON r.r_regionkey = n.n_regionkey"
)


def fixture_sql() -> str:
    """The adapter as one SELECT (runs unchanged in Spark SQL and DuckDB)."""
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in FIXTURE_COLUMNS.items())
    return f"SELECT\n  {cols}\n{FIXTURE_FROM}"


def events_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared source rows derived from the test tables at ``sf_dir``."""
    from .export import balance_partitions
    e = balance_partitions(spark.read.parquet(f"{sf_dir}/events.parquet")).alias("e")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").alias("n")
    r = spark.read.parquet(f"{sf_dir}/region.parquet").alias("r")
    # nation / region are fixed-size reference tables (25 / 5 rows): the
    # planner broadcasts them from file statistics.
    joined = (e.join(n, F.col("n.n_nationkey") == F.col("e.user_id") % 20)
               .join(r, F.col("r.r_regionkey") == F.col("n.n_regionkey")))
    # one selectExpr call: the whole projection is parsed JVM-side at once
    exprs = [f"CAST({FIXTURE_COLUMNS.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
             for f in SOURCE_SCHEMA.fields]
    return joined.selectExpr(*exprs)


def split_deliveries(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two deliveries of the same period: morning (hour < 12) then afternoon.

    Both halves together are the whole table; visits appear in both, so the
    second load exercises the upsert / replace-by-visit paths.
    """
    hour = F.hour(F.col("responsedate"))
    return source.filter(hour < 12), source.filter(hour >= 12)
