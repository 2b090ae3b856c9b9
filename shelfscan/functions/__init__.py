"""Column expressions (all built-in Spark functions, no Python UDFs)."""

from .dates import (epoch_micros, excel_serial_of, parse_dateid, parse_excel_serial,
                    round_to_second, to_ntz, week_mode1)
from .geo import haversine_m
from .retail import case_banner, decimal_text, gps_severity, map_link, sos_dollar
from .text import clean_float, clean_text, contains_ci, question_to_column, strip_text, upper_trim

__all__ = [
    "case_banner", "clean_float", "clean_text", "contains_ci", "decimal_text", "epoch_micros",
    "excel_serial_of", "gps_severity", "haversine_m", "map_link", "parse_dateid",
    "parse_excel_serial", "question_to_column", "round_to_second", "sos_dollar", "strip_text", "to_ntz",
    "upper_trim", "week_mode1",
]
