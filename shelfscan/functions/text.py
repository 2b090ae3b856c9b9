"""Text scalars as Column -> Column expressions (JVM side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.column import Column as _Col

# Whitespace removed by Python's str.strip(): every char with str.isspace()
# (Unicode White_Space plus the separators \x1c-\x1f), built by rule.
WHITESPACE = [chr(c) for c in range(0x110000) if chr(c).isspace()]
WS_CHARS = "".join(WHITESPACE)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _c(x) -> Column:
    return x if isinstance(x, _Col) else F.col(x)


def strip_text(x) -> Column:
    """Text without surrounding whitespace (Python ``str.strip`` semantics); null stays null.

    ``btrim`` with an explicit character set: a native trim, no regex.
    """
    return F.btrim(_c(x).cast("string"), F.lit(WS_CHARS))


def clean_text(x) -> Column:
    """Null / blank -> null, otherwise the text without surrounding whitespace."""
    return F.nullif(strip_text(x), F.lit(""))


def clean_float(x) -> Column:
    """Plain decimal / scientific number text -> DOUBLE, anything else -> null.

    The regex guard keeps Spark-only forms (``1.5d``, ``NaN``, ``Infinity``)
    out of the cast, so only ordinary numbers survive.
    """
    c = clean_text(x)
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def question_to_column(q) -> Column:
    """Question text -> stable column name ``q_<slug>`` (slug cut to 50 chars)."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(_c(q)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    slug = F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("q_"), F.substring(slug, 1, 50))


def upper_trim(x) -> Column:
    return F.upper(F.trim(_c(x)))


def contains_ci(x, keyword: str) -> Column:
    """Upper-cased substring test; null input -> false (pandas na=False)."""
    return F.coalesce(F.upper(_c(x)).contains(keyword), F.lit(False))
