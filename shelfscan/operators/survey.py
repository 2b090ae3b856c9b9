"""Normalised survey-response fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import EXCLUDED_STORE_FORMATS
from ..functions import clean_text, round_to_second, strip_text
from ..sources.schema import SURVEY_COLUMNS, VISIT_KEY


def filter_store_format(src: DataFrame) -> DataFrame:
    """Drop GROCERY / ICE CREAM stores (trimmed, upper-cased); null format is kept."""
    excluded = F.coalesce(F.upper(strip_text("store_format")).isin(*EXCLUDED_STORE_FORMATS), F.lit(False))
    return src.filter(~excluded)


def survey_rows(src: DataFrame) -> DataFrame:
    """Cleaned survey columns keyed by the natural visit key (before the visit join)."""
    return filter_store_format(src).select(
        "visit_date",
        clean_text("employee_code").alias("employee_code"),
        clean_text("store_code").alias("store_code"),
        clean_text("product_code").alias("product_code"),
        clean_text("task").alias("task"),
        clean_text("title").alias("title"),
        clean_text("question").alias("question"),
        clean_text("response").alias("response"),
        round_to_second("responsedate").alias("response_datetime"),
        F.col("latitude").cast("decimal(10,6)").alias("latitude"),
        F.col("longitude").cast("decimal(10,6)").alias("longitude"),
    )


def build_survey(src: DataFrame, visit_lookup: DataFrame) -> DataFrame:
    """Format filter -> clean -> inner join on the visit key -> drop exact duplicates.

    The join is an equi-join on (visit_date, employee_code, store_code): AQE
    broadcasts the visit side when its runtime size allows, otherwise a
    sort-merge join whose skewed partitions are split.  ``distinct`` runs as a
    partial + final aggregate, so repeated rows collapse map-side.
    """
    rows = survey_rows(src)
    lookup = visit_lookup.select("visit_id", *VISIT_KEY)
    return rows.join(lookup, VISIT_KEY, "inner").select(*SURVEY_COLUMNS).distinct()


def split_valid_questions(survey: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loadable rows, quarantine): the fact's ``question`` must not be null."""
    return survey.filter(F.col("question").isNotNull()), survey.filter(F.col("question").isNull())
