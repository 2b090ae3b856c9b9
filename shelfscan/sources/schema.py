"""Canonical column sets of the prepared source and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Prepared source: raw text kept as delivered (cleaning happens per builder, as
# each consumer cleans differently), dates / times / GPS already typed.
SOURCE_SCHEMA = T.StructType([
    T.StructField("src_ordinal", T.LongType()),
    T.StructField("visit_date", T.DateType()),
    T.StructField("responsedate", T.TimestampNTZType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.StringType()),
    T.StructField("employee_code", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("store_code", T.StringType()),
    T.StructField("store_name", T.StringType()),
    T.StructField("store_city", T.StringType()),
    T.StructField("store_state", T.StringType()),
    T.StructField("store_region", T.StringType()),
    T.StructField("store_format", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("product_description", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sub_category", T.StringType()),
    T.StructField("latitude", T.DecimalType(10, 6)),
    T.StructField("longitude", T.DecimalType(10, 6)),
    T.StructField("task", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("response", T.StringType()),
])
SOURCE_COLUMNS = [f.name for f in SOURCE_SCHEMA.fields]

# Raw export header (trimmed + lower-cased) -> canonical name.
EXPORT_HEADER = {
    "dateid": "visit_date",
    "responsedate": "responsedate",
    "year": "year",
    "month": "month",
    "employeecode": "employee_code",
    "username": "username",
    "storecode": "store_code",
    "storename": "store_name",
    "storecity": "store_city",
    "storestate": "store_state",
    "storeregion": "store_region",
    "storeformat": "store_format",
    "productcode": "product_code",
    "productbarcode": "barcode",
    "productdescription": "product_description",
    "brandname": "brand",
    "category": "category",
    "subcategory": "sub_category",
    "latitude": "latitude",
    "longitude": "longitude",
    "task": "task",
    "title": "title",
    "question": "question",
    "response": "response",
}

VISIT_KEY = ["visit_date", "employee_code", "store_code"]

SURVEY_COLUMNS = [
    "visit_id", "employee_code", "store_code", "product_code", "task", "title",
    "question", "response", "response_datetime", "latitude", "longitude",
]

FINDINGS_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("rule_code", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("visit_id", T.LongType()),
    T.StructField("store_code", T.StringType()),
    T.StructField("employee_code", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("actual_value", T.StringType()),
    T.StructField("expected_value", T.StringType()),
    T.StructField("metric_value", T.DecimalType(12, 4)),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("details_json", T.StringType()),
])
FINDINGS_COLUMNS = [f.name for f in FINDINGS_SCHEMA.fields]

LEGACY_RESULTS_SCHEMA = T.StructType([
    T.StructField("validation_id", T.LongType()),
    T.StructField("rule_code", T.StringType()),
    T.StructField("visit_id", T.LongType()),
    T.StructField("store_code", T.StringType()),
    T.StructField("employee_code", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("banner", T.StringType()),
    T.StructField("yes_count", T.LongType()),
    T.StructField("no_count", T.LongType()),
    T.StructField("total_answers", T.LongType()),
    T.StructField("availability_rate", T.DoubleType()),
    T.StructField("detected_at", T.TimestampNTZType()),
])
