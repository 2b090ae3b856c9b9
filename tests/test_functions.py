"""Scalar column functions: edge-case tables checked against plain Python."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shelfscan import functions as S


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def py_clean_text(v):
    if v is None:
        return None
    t = str(v).strip()
    return t or None


def test_clean_text_matches_python_strip(spark):
    ws = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    values = [None, "", "   ", " a ", "\tb\n", "c" + "".join(ws), "".join(ws) + "d", "e f", "\x1cg\x1f", "　h "]
    assert col_values(spark, values, S.clean_text) == [py_clean_text(v) for v in values]


def py_clean_float(v):
    t = py_clean_text(v)
    if t is None:
        return None
    try:
        x = float(t)
    except ValueError:
        return None
    return None if math.isnan(x) or math.isinf(x) else x


@pytest.mark.parametrize("v", ["1", " 2.5 ", "-3", "+4.", ".5", "1e3", "1E-2", "abc", "1.5d", "1.5f", "",
                               None, "$ 4", "1,5", "0x10"])
def test_clean_float(spark, v):
    assert col_values(spark, [v], S.clean_float) == [py_clean_float(v)]


def test_question_to_column(spark):
    cases = {
        "Produit disponible ?": "q_produit_disponible",
        "  Callcycle deviation ": "q_callcycle_deviation",
        "???": "q_unknown",
        "Éte 2024!": "q_te_2024",
        "x" * 80: "q_" + "x" * 50,
        "a__b": "q_a_b",
    }
    assert col_values(spark, list(cases), S.question_to_column) == list(cases.values())


def mysql_week_mode1(d: dt.date) -> int:
    """WEEK(d, 1): Monday first, 0-53, week 1 is the first week with >= 4 days."""
    jan1 = dt.date(d.year, 1, 1)
    w = jan1.weekday()
    first_monday_week1 = jan1 - dt.timedelta(days=w) if w <= 3 else jan1 + dt.timedelta(days=7 - w)
    if d < first_monday_week1:
        return 0
    return (d - first_monday_week1).days // 7 + 1


def test_week_mode1_against_definition(spark):
    days = [dt.date(2019, 12, 1) + dt.timedelta(days=i) for i in range(0, 2300, 3)]
    got = col_values(spark, days, S.week_mode1, "date")
    assert got == [mysql_week_mode1(d) for d in days]


def test_haversine(spark):
    df = spark.createDataFrame([(33.5, -7.6, 33.51, -7.61), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(S.haversine_m("a", "b", "c", "d")).collect()]

    def hav(lat1, lon1, lat2, lon2):
        p1, p2 = math.radians(lat1), math.radians(lat2)
        a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
        return 6371000 * 2 * math.asin(math.sqrt(a))
    assert got[0] == pytest.approx(hav(33.5, -7.6, 33.51, -7.61), rel=1e-12)
    assert got[1] == 0.0


def test_parse_dateid(spark):
    vals = ["20240115", "20241315", "20240115.0", " 20240229 ", "20230229", None, "abc"]
    exp = [dt.date(2024, 1, 15), None, None, dt.date(2024, 2, 29), None, None, None]
    assert col_values(spark, vals, S.parse_dateid) == exp


def test_parse_excel_serial_and_rounding(spark):
    vals = ["45292", "45292.5", "45292.000005787", "x", None, "45292.0000057870"]
    got = col_values(spark, vals, S.parse_excel_serial)
    base = dt.datetime(2024, 1, 1)
    assert got[0] == base and got[1] == base + dt.timedelta(hours=12)
    assert got[2] == base + dt.timedelta(microseconds=round(0.000005787 * 86400e6)) and got[3] is None and got[4] is None
    rounded = col_values(spark, vals[:3], lambda c: S.round_to_second(S.parse_excel_serial(c)))
    assert rounded == [base, base + dt.timedelta(hours=12), base]


def test_round_to_second_ties_to_even(spark):
    ts = [dt.datetime(2024, 1, 1, 0, 0, 1, 500000), dt.datetime(2024, 1, 1, 0, 0, 2, 500000),
          dt.datetime(2024, 1, 1, 0, 0, 2, 500001)]
    got = col_values(spark, ts, S.round_to_second, "timestamp_ntz")
    assert got == [dt.datetime(2024, 1, 1, 0, 0, 2), dt.datetime(2024, 1, 1, 0, 0, 2), dt.datetime(2024, 1, 1, 0, 0, 3)]


def test_map_link_and_banner_and_dollar(spark):
    df = spark.createDataFrame([("33.500000", "-7.600000"), (None, "1.0")], "a string, b string")
    links = [r[0] for r in df.select(S.map_link(F.col("a").cast("decimal(10,6)"), F.col("b").cast("decimal(10,6)"))).collect()]
    assert links == ["https://www.google.com/maps?q=33.5,-7.6", None]
    names = ["Marjane Market Ain", "acima x", "MARJANE", " carrefour market", "Carrefour", "Attacadao", "Atacadao 2",
             "Aswak Assalam", "Epicerie", None]
    assert col_values(spark, names, S.case_banner) == [
        "MARJANE MARKET", "MARJANE MARKET", "MARJANE", "CARREFOUR MARKET", "CARREFOUR", "ATACADAO", "ATACADAO",
        "ASWAK ASSALAM", "OTHER", "OTHER"]
    assert col_values(spark, ["$ 12.5 and $ 3", "total 5", "$abc", None, "$7"], S.sos_dollar) == ["12.5", None, None, None, "7"]
