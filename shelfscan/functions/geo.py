"""Geographic scalars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import EARTH_RADIUS_M
from .text import _c


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres between two points given in degrees."""
    lat1, lon1, lat2, lon2 = (_c(v).cast("double") for v in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
