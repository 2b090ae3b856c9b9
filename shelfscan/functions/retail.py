"""Domain scalars: banner, maps link, SOS total, severities, entity ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import (BANNER_OTHER, BANNER_PREFIXES, GPS_HIGH_DISTANCE_METERS,
                         MAP_LINK_PREFIX, SOS_DOLLAR_PATTERN)
from .text import _c


def case_banner(store_name) -> Column:
    """Store name prefix -> banner; first matching prefix wins, else OTHER."""
    name = F.upper(F.trim(_c(store_name)))
    expr = None
    for prefix, banner in BANNER_PREFIXES:
        cond = name.startswith(prefix)
        expr = F.when(cond, F.lit(banner)) if expr is None else expr.when(cond, F.lit(banner))
    return expr.otherwise(F.lit(BANNER_OTHER))


def decimal_text(x) -> Column:
    """DECIMAL(10,6) rendered the way Python prints the equivalent float.

    Python ``str(float)`` drops trailing zeros but keeps one decimal digit.
    """
    s = F.regexp_replace(_c(x).cast("decimal(10,6)").cast("string"), "0+$", "")
    return F.regexp_replace(s, r"\.$", ".0")


def map_link(lat, lon) -> Column:
    """Maps URL for a position; null when either coordinate is missing."""
    lat, lon = _c(lat), _c(lon)
    return F.when(lat.isNotNull() & lon.isNotNull(),
                  F.concat(F.lit(MAP_LINK_PREFIX), decimal_text(lat), F.lit(","), decimal_text(lon)))


def sos_dollar(x) -> Column:
    """First ``$ <number>`` in a response (number text), else null."""
    return F.nullif(F.regexp_extract(_c(x), SOS_DOLLAR_PATTERN, 1), F.lit(""))


def gps_severity(distance_m) -> Column:
    return F.when(_c(distance_m) >= GPS_HIGH_DISTANCE_METERS, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
