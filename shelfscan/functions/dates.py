"""Date / time scalars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _c, clean_text

EXCEL_EPOCH_OFFSET_DAYS = 25569  # days from 1899-12-30 to 1970-01-01
MICROS_PER_DAY = 86_400_000_000


def parse_dateid(x) -> Column:
    """``yyyyMMdd`` text -> DATE; anything unparsable -> null."""
    return F.try_to_date(clean_text(x), "yyyyMMdd")


def parse_excel_serial(x) -> Column:
    """Excel day serial (origin 1899-12-30) -> TIMESTAMP_NTZ at microsecond precision."""
    serial = clean_text(x)
    serial = F.when(serial.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), serial.try_cast("double"))
    micros = F.round((serial - F.lit(EXCEL_EPOCH_OFFSET_DAYS)) * F.lit(MICROS_PER_DAY)).cast("bigint")
    return to_ntz(F.timestamp_micros(micros))


def to_ntz(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def epoch_micros(ts) -> Column:
    """Microseconds since epoch of a (NTZ or LTZ) timestamp read as UTC."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def round_to_second(ts) -> Column:
    """Nearest second, ties to even (as pandas ``dt.round('s')``)."""
    micros = epoch_micros(ts).cast("decimal(20,0)")
    secs = F.bround(micros / F.lit(1_000_000), 0).cast("bigint")
    return to_ntz(F.timestamp_seconds(secs))


def excel_serial_of(ts) -> Column:
    """Inverse of parse_excel_serial (used to render exports)."""
    return epoch_micros(ts) / F.lit(float(MICROS_PER_DAY)) + F.lit(EXCEL_EPOCH_OFFSET_DAYS)


def week_mode1(d) -> Column:
    """MySQL ``WEEK(d, 1)``: weeks start Monday, 0..53, week 1 has >= 4 days."""
    d = _c(d).cast("date")
    w = F.weekday(F.trunc(d, "YEAR"))  # 0 = Monday
    return (F.floor((F.dayofyear(d) - 1 + w) / 7).cast("int")
            + F.when(w <= 3, F.lit(1)).otherwise(F.lit(0)))
