from .export import norm_header, prepare_source, scan_export
from .fixture import events_source, fixture_sql, split_deliveries
from .schema import FINDINGS_COLUMNS, FINDINGS_SCHEMA, SOURCE_COLUMNS, SOURCE_SCHEMA, VISIT_KEY

__all__ = ["norm_header", "prepare_source", "scan_export", "events_source", "fixture_sql",
           "split_deliveries", "FINDINGS_COLUMNS", "FINDINGS_SCHEMA", "SOURCE_COLUMNS",
           "SOURCE_SCHEMA", "VISIT_KEY"]
