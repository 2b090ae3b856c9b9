"""Order-aware picks as declarative aggregates, without a sort of rows.

Spark runs them as a partial (map-side) and a final aggregate, so a hot key is
collapsed before the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import functions as F


def last_value(col, order_col: str = "src_ordinal"):
    """Aggregate: value of the latest row (null values included)."""
    return F.max_by(col if not isinstance(col, str) else F.col(col), F.col(order_col))
