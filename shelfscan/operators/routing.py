"""Route answered questions to their task tables and tag them with ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (GLACE_KEYWORD, GLACE_TABLE, LOCATION_TABLES, TABLES_WITH_PRODUCT,
                         TABLES_WITH_TASK, TABLES_WITH_TITLE, TASK_TABLE_MAP, TITLE_TABLE_MAP)
from ..functions import clean_text, contains_ci, strip_text



def route_expr() -> Column:
    """Target table: exact trimmed task match first, then the first title keyword."""
    tables = F.create_map(*[F.lit(x) for pair in TASK_TABLE_MAP.items() for x in pair])

    def by_title(upper: Column) -> Column:
        return reduce(lambda expr, pair: expr.when(upper.contains(pair[0]), F.lit(pair[1])), TITLE_TABLE_MAP.items(), F)

    # the upper-cased title is bound once, by a transform over an array of one
    return F.coalesce(F.element_at(tables, strip_text("task")), F.element_at(F.transform(F.array(F.upper("title")), by_title), 1))


def with_route(src: DataFrame) -> DataFrame:
    return src.withColumn("target_table", route_expr())


def route_task_table(src: DataFrame) -> DataFrame:
    """Routed rows only (unmatched rows are dropped).

    A row goes to each table of an array of one or none: a filter on the table
    would find it again for every condition.
    """
    return src.withColumn("target_table", F.explode(F.array_compact(F.array(route_expr()))))


def unmatched_rows(src: DataFrame) -> DataFrame:
    return with_route(src).filter(F.col("target_table").isNull()).drop("target_table")


def filter_glace(routed: DataFrame) -> DataFrame:
    """In the secondary-placement table drop rows whose task mentions GLACE (null task kept)."""
    glace = (F.col("target_table") == GLACE_TABLE) & contains_ci("task", GLACE_KEYWORD)
    return routed.filter(~glace)


def tag_task_rows(src: DataFrame, visits: DataFrame, products: DataFrame) -> DataFrame:
    """Routed rows with ``visit_id`` (inner: rows without a visit are dropped)
    and ``product_id`` (left: rows without a known product are kept)."""
    routed = filter_glace(route_task_table(src))
    keyed = routed.withColumn("_emp", clean_text("employee_code")).withColumn("_sto", clean_text("store_code")) \
                  .withColumn("_prod", clean_text("product_code"))
    v = visits.select("visit_id", F.col("visit_date").alias("_vd"),
                      F.col("employee_code").alias("_ve"), F.col("store_code").alias("_vs"))
    tagged = keyed.join(v, (F.col("visit_date") == F.col("_vd")) & (F.col("_emp") == F.col("_ve"))
                        & (F.col("_sto") == F.col("_vs")), "inner")
    # rows without a product code are many: dealt out by their ordinal, they match nothing
    keyless = F.concat(F.lit("\0"), F.pmod("src_ordinal", F.lit(10_007)).cast("string"))
    tagged = tagged.withColumn("_prod", F.coalesce("_prod", keyless))
    p = products.select(F.col("product_code").alias("_pc"), "product_id")
    tagged = tagged.join(p, F.col("_prod") == F.col("_pc"), "left")
    return tagged.drop("_emp", "_sto", "_prod", "_vd", "_ve", "_vs", "_pc")


def table_flags(table: str) -> dict[str, bool]:
    return {
        "has_product": table in TABLES_WITH_PRODUCT,
        "has_title": table in TABLES_WITH_TITLE,
        "has_task": table in TABLES_WITH_TASK,
        "has_location_meta": table in LOCATION_TABLES,
    }


def batch_task_tables(tagged: DataFrame) -> DataFrame:
    """Per target table: row count, distinct non-empty questions and shape flags."""
    q = clean_text("question")
    agg = tagged.groupBy("target_table").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(q).alias("n_questions"),
    )
    flag = lambda s: F.col("target_table").isin(*sorted(s))
    return agg.select(
        "target_table", "n_rows",
        F.when(F.col("target_table") == "task_sos", F.lit(None).cast("bigint"))
         .otherwise(F.col("n_questions")).alias("n_questions"),
        flag(TABLES_WITH_PRODUCT).alias("has_product"),
        flag(TABLES_WITH_TITLE).alias("has_title"),
        flag(TABLES_WITH_TASK).alias("has_task"),
        flag(LOCATION_TABLES).alias("has_location_meta"),
    )
