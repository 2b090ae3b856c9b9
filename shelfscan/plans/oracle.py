"""DuckDB oracle SQL for every catalog query (views: the test tables).

Written independently of the Spark code: plain SQL over ``events``,
``nation`` and ``region`` through the same fixture SELECT.  Null-keeping
"first / last row" picks use ``arg_min_null`` / ``arg_max_null``; "first
non-null" uses ``arg_min`` (which skips null values).
"""

from __future__ import annotations

from ..constants import (BANNER_OTHER, BANNER_PREFIXES, GLACE_KEYWORD, GLACE_TABLE, GPS_HIGH_DISTANCE_METERS,
                         GPS_RULE_CODE, GPS_RULE_DESCRIPTION, GPS_RULE_NAME, GPS_RULE_QUESTION, GPS_SEVERITY,
                         GPS_SOURCE_TABLE, GPS_WARNING_DISTANCE_METERS, MAP_LINK_PREFIX, OSA_RULE_CODE,
                         OSA_RULE_DESCRIPTION, OSA_RULE_NAME, OSA_SEVERITY, OSA_SOURCE_TABLE, TASK_TABLE_MAP, TITLE_TABLE_MAP)
from ..sources.fixture import fixture_sql


# ------------------------------------------------------------ fragments ----

def ct(x: str) -> str:
    return f"NULLIF(regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g'), '')"


def strip(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def dtext(x: str) -> str:
    return f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '0+$', ''), '\\.$', '.0')"


def link(lat: str, lon: str) -> str:
    return (f"CASE WHEN {lat} IS NOT NULL AND {lon} IS NOT NULL THEN "
            f"'{MAP_LINK_PREFIX}' || {dtext(lat)} || ',' || {dtext(lon)} END")


def cfloat(x: str) -> str:
    c = ct(x)
    return (f"CASE WHEN regexp_full_match({c}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
            f"THEN TRY_CAST({c} AS DOUBLE) END")


def rts(ts: str) -> str:
    us = f"epoch_us({ts})"
    return (f"make_timestamp(({us} // 1000000 + CASE WHEN {us} % 1000000 > 500000 OR "
            f"({us} % 1000000 = 500000 AND ({us} // 1000000) % 2 = 1) THEN 1 ELSE 0 END) * 1000000)")


def week1(d: str) -> str:
    w = f"(isodow(date_trunc('year', {d})) - 1)"
    return f"(CAST(floor((dayofyear({d}) - 1 + {w}) / 7) AS INTEGER) + CASE WHEN {w} <= 3 THEN 1 ELSE 0 END)"


def banner(x: str) -> str:
    whens = " ".join(f"WHEN upper(trim({x})) LIKE '{p}%' THEN '{b}'" for p, b in BANNER_PREFIXES)
    return f"CASE {whens} ELSE '{BANNER_OTHER}' END"


def route(task: str, title: str) -> str:
    parts = [f"WHEN {strip(task)} = '{k}' THEN '{t}'" for k, t in TASK_TABLE_MAP.items()]
    parts += [f"WHEN contains(upper({title}), '{k}') THEN '{t}'" for k, t in TITLE_TABLE_MAP.items()]
    return "CASE " + " ".join(parts) + " END"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a, b, c, d = (f"CAST({v} AS DOUBLE)" for v in (lat1, lon1, lat2, lon2))
    return (f"(12742000.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) "
            f"+ cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))")


def rdec(x: str, scale: int, prec: int = 14) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(24,10)), {scale}) AS DECIMAL({prec},{scale}))"


_MISSING = ["store_state", "barcode", "product_description", "brand", "category", "sub_category"]
SRC = ("src AS (SELECT * REPLACE (CAST(year AS INTEGER) AS year), "
       + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in _MISSING)
       + f" FROM (\n{fixture_sql()}\n))")
STORE_ATTRS = ["store_name", "store_city", "store_state", "store_region", "store_format"]
PRODUCT_ATTRS = ["barcode", "product_description", "brand", "category", "sub_category"]


def build_dim(out: str, src: str, code: str, attrs: list[str]) -> str:
    inner = ", ".join([f"{ct(code)} AS {code}"] + [f"{ct(a)} AS {a}" for a in attrs])
    picks = ", ".join(f"arg_min_null({a}, src_ordinal) AS {a}" for a in attrs)
    return (f"{out} AS (SELECT {code}, {picks}, min(src_ordinal) AS first_ordinal "
            f"FROM (SELECT src_ordinal, {inner} FROM {src}) WHERE {code} IS NOT NULL GROUP BY {code})")


def build_visits(out: str, src: str) -> str:
    lat, lon = f"CAST({cfloat('latitude')} AS DECIMAL(10,6))", f"CAST({cfloat('longitude')} AS DECIMAL(10,6))"
    attrs = ["year", "month", "latitude", "longitude", "map_link"]
    picks = ", ".join(f"arg_min_null({a}, src_ordinal) AS {a}" for a in attrs)
    return (f"{out}_c AS (SELECT src_ordinal, visit_date, year, {ct('month')} AS month, "
            f"{ct('employee_code')} AS employee_code, {ct('store_code')} AS store_code, "
            f"{lat} AS latitude, {lon} AS longitude FROM {src}),\n"
            f"{out} AS (SELECT visit_date, employee_code, store_code, {picks}, min(src_ordinal) AS first_ordinal "
            f"FROM (SELECT *, {link('latitude', 'longitude')} AS map_link FROM {out}_c) "
            f"WHERE visit_date IS NOT NULL AND employee_code IS NOT NULL AND store_code IS NOT NULL "
            f"GROUP BY visit_date, employee_code, store_code)")


def first_load(sfx: str, src: str) -> str:
    """Base tables of one load into empty tables: ids number the keys by their first rows."""
    sa, pa = ", ".join(STORE_ATTRS), ", ".join(PRODUCT_ATTRS)
    return ",\n".join([
        build_dim(f"empb{sfx}", src, "employee_code", ["username"]),
        build_dim(f"stob{sfx}", src, "store_code", STORE_ATTRS),
        build_dim(f"prob{sfx}", src, "product_code", PRODUCT_ATTRS),
        build_visits(f"visb{sfx}", src),
        f"emp{sfx} AS (SELECT row_number() OVER (ORDER BY first_ordinal) AS employee_id, employee_code, username FROM empb{sfx})",
        f"sto{sfx} AS (SELECT row_number() OVER (ORDER BY first_ordinal) AS store_id, store_code, {sa} FROM stob{sfx})",
        f"pro{sfx} AS (SELECT row_number() OVER (ORDER BY first_ordinal) AS product_id, product_code, {pa} FROM prob{sfx})",
        f"vis{sfx} AS (SELECT row_number() OVER (ORDER BY v.first_ordinal) AS visit_id, v.visit_date, v.year, v.month, "
        f"e.employee_id, s.store_id, v.employee_code, v.store_code, v.latitude, v.longitude, v.map_link "
        f"FROM visb{sfx} v JOIN emp{sfx} e ON e.employee_code = v.employee_code "
        f"JOIN sto{sfx} s ON s.store_code = v.store_code)",
        f"lk{sfx} AS (SELECT v.visit_id, v.visit_date, e.employee_code, s.store_code FROM vis{sfx} v "
        f"JOIN emp{sfx} e ON e.employee_id = v.employee_id JOIN sto{sfx} s ON s.store_id = v.store_id)",
    ])


def merge_dim(out: str, old: str, new: str, keys: list[str], id_col: str, attrs: list[str]) -> str:
    on = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    kcols = ", ".join(f"coalesce(o.{k}, n.{k}) AS {k}" for k in keys)
    acols = ", ".join(f"CASE WHEN n._new THEN n.{a} ELSE o.{a} END AS {a}" for a in attrs)
    return (f"{out} AS (SELECT {kcols}, CAST(coalesce(o.{id_col}, "
            f"(SELECT coalesce(max({id_col}), 0) FROM {old}) + n.number) AS BIGINT) AS {id_col}, {acols} "
            f"FROM {old} o FULL OUTER JOIN (SELECT *, true AS _new, row_number() OVER (PARTITION BY known ORDER BY first_ordinal) AS number "
            f"FROM (SELECT n.*, EXISTS (SELECT 1 FROM {old} o WHERE {on}) AS known FROM {new} n)) n ON {on})")


def second_load() -> str:
    """Morning load (suffix 1) then afternoon load merged into it (suffix 2)."""
    return ",\n".join([
        "d1 AS (SELECT * FROM src WHERE hour(responsedate) < 12)",
        "d2 AS (SELECT * FROM src WHERE hour(responsedate) >= 12)",
        first_load("1", "d1"),
        build_dim("empb2", "d2", "employee_code", ["username"]),
        build_dim("stob2", "d2", "store_code", STORE_ATTRS),
        build_dim("prob2", "d2", "product_code", PRODUCT_ATTRS),
        build_visits("visb2", "d2"),
        merge_dim("emp2", "emp1", "empb2", ["employee_code"], "employee_id", ["username"]),
        merge_dim("sto2", "sto1", "stob2", ["store_code"], "store_id", STORE_ATTRS),
        merge_dim("pro2", "pro1", "prob2", ["product_code"], "product_id", PRODUCT_ATTRS),
        "visn2 AS (SELECT v.*, e.employee_id, s.store_id FROM visb2 v "
        "JOIN emp2 e ON e.employee_code = v.employee_code JOIN sto2 s ON s.store_code = v.store_code)",
        merge_dim("vis2", "vis1", "visn2", ["visit_date", "employee_code", "store_code"], "visit_id",
                  ["year", "month", "employee_id", "store_id", "latitude", "longitude", "map_link"]),
        "lk2 AS (SELECT v.visit_id, v.visit_date, e.employee_code, s.store_code FROM vis2 v "
        "JOIN emp2 e ON e.employee_id = v.employee_id JOIN sto2 s ON s.store_id = v.store_id)",
        "affected AS (SELECT v.visit_id FROM vis2 v WHERE EXISTS (SELECT 1 FROM visb2 b WHERE "
        "b.visit_date = v.visit_date AND b.employee_code = v.employee_code AND b.store_code = v.store_code))",
    ])


SURVEY_SELECT = ("l.visit_id, r.employee_code, r.store_code, r.product_code, r.task, r.title, r.question, "
                 "r.response, r.response_datetime, r.latitude, r.longitude")


def survey(out: str, src: str, lk: str) -> str:
    fmt_ok = f"NOT coalesce(upper({strip('store_format')}) IN ('GROCERY', 'ICE CREAM'), false)"
    cols = ", ".join([
        "visit_date", f"{ct('employee_code')} AS employee_code", f"{ct('store_code')} AS store_code",
        f"{ct('product_code')} AS product_code", f"{ct('task')} AS task", f"{ct('title')} AS title",
        f"{ct('question')} AS question", f"{ct('response')} AS response",
        f"{rts('responsedate')} AS response_datetime",
        "CAST(latitude AS DECIMAL(10,6)) AS latitude", "CAST(longitude AS DECIMAL(10,6)) AS longitude"])
    return (f"{out} AS (SELECT DISTINCT {SURVEY_SELECT} FROM (SELECT {cols} FROM {src} WHERE {fmt_ok}) r "
            f"JOIN {lk} l ON l.visit_date = r.visit_date AND l.employee_code = r.employee_code "
            f"AND l.store_code = r.store_code)")


ROUTED = f"routed AS (SELECT *, {route('task', 'title')} AS target_table FROM src)"
TAGGED = ("tagged AS (SELECT r.*, v.visit_id, p.product_id FROM routed r "
          f"JOIN vis v ON v.visit_date = r.visit_date AND v.employee_code = {ct('r.employee_code')} "
          f"AND v.store_code = {ct('r.store_code')} "
          f"LEFT JOIN pro p ON p.product_code = {ct('r.product_code')} "
          f"WHERE r.target_table IS NOT NULL AND NOT (r.target_table = '{GLACE_TABLE}' "
          f"AND coalesce(contains(upper(r.task), '{GLACE_KEYWORD}'), false)))")


def q2c(q: str) -> str:
    slug = f"regexp_replace(regexp_replace(lower({q}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"('q_' || substr(coalesce(NULLIF({slug}, ''), 'unknown'), 1, 50))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = [SRC, first_load("", "src")]
SURV = BASE + [survey("survey_t", "src", "lk")]
TAG = BASE + [ROUTED, TAGGED]

# --------------------------------------------------------------- rules -----

OSA_BASE = (f"osa_base AS (SELECT s.visit_id, s.employee_code, s.store_code, s.product_code, s.question, s.response, "
            f"s.response_datetime, {banner('st.store_name')} AS banner, CAST(year(s.response_datetime) AS INTEGER) AS year_num, "
            f"{week1('s.response_datetime')} AS week_num FROM survey_t s JOIN sto st ON st.store_code = s.store_code "
            f"WHERE s.product_code IS NOT NULL AND s.response IN ('Oui', 'Non') AND upper(s.question) LIKE '%DISPONIBLE%')")
OSA_WEEKLY = ("osa_weekly AS (SELECT year_num, week_num, banner, product_code, question, "
              "CAST(count(*) AS BIGINT) AS total_answers, "
              "CAST(sum(CASE WHEN response = 'Oui' THEN 1 ELSE 0 END) AS BIGINT) AS yes_count, "
              "CAST(sum(CASE WHEN response = 'Non' THEN 1 ELSE 0 END) AS BIGINT) AS no_count, "
              "round(sum(CASE WHEN response = 'Oui' THEN 1 ELSE 0 END) * 100.0 / NULLIF(count(*), 0), 2) "
              "AS availability_rate FROM {base} GROUP BY year_num, week_num, banner, product_code, question "
              "HAVING count(*) >= 10 AND sum(CASE WHEN response = 'Oui' THEN 1 ELSE 0 END) >= 8)")
OSA_KEYS = "b.year_num = w.year_num AND b.week_num = w.week_num AND b.banner = w.banner " \
           "AND b.product_code = w.product_code AND b.question = w.question"
OSA_FOUND = (f"osa_found AS (SELECT b.visit_id, b.employee_code, b.store_code, b.product_code, b.banner, b.question, "
             f"b.response, w.total_answers, w.yes_count, w.no_count, CAST(w.availability_rate AS DOUBLE) AS availability_rate, "
             f"CAST(b.visit_id AS VARCHAR) || ':' || b.product_code AS entity_id, "
             f"'OSA response is ''Non'' while weekly availability for SKU ' || b.product_code || ' in banner ' "
             f"|| b.banner || ' is ' || printf('%.2f', w.availability_rate) || '%.' AS message "
             f"FROM {{base}} b JOIN osa_weekly w ON {OSA_KEYS} WHERE b.response = 'Non' AND w.availability_rate >= 80 {{scope}})")

GPS_ROWS = ("gps AS (SELECT v.visit_id, v.visit_date, e.employee_code, e.username, s.store_code, s.store_name, "
            "CAST(year(v.visit_date) AS INTEGER) AS year_num, CAST(month(v.visit_date) AS INTEGER) AS month_num, "
            "CAST(v.latitude AS DECIMAL(10,6)) AS latitude, CAST(v.longitude AS DECIMAL(10,6)) AS longitude "
            "FROM vis v JOIN emp e ON e.employee_id = v.employee_id JOIN sto s ON s.store_id = v.store_id "
            "WHERE v.visit_date IS NOT NULL AND v.latitude IS NOT NULL AND v.longitude IS NOT NULL "
            "AND v.latitude <> 0 AND v.longitude <> 0)")
GPS_MED = ("gps_l AS (SELECT *, count(*) OVER w AS n, list_sort(list(latitude) OVER w) AS lats, "
           "list_sort(list(longitude) OVER w) AS lons FROM {rows} "
           "WINDOW w AS (PARTITION BY employee_code, store_code, year_num, month_num)),\n"
           "gps_m AS (SELECT * EXCLUDE (lats, lons), "
           "CAST((lats[CAST((n + 1) // 2 AS INTEGER)] + lats[CAST(n // 2 + 1 AS INTEGER)]) * 0.5 AS DECIMAL(12,7)) AS median_latitude, "
           "CAST((lons[CAST((n + 1) // 2 AS INTEGER)] + lons[CAST(n // 2 + 1 AS INTEGER)]) * 0.5 AS DECIMAL(12,7)) AS median_longitude "
           "FROM gps_l)")
_D = hav("latitude", "longitude", "median_latitude", "median_longitude")
_SEV = f"CASE WHEN d >= {GPS_HIGH_DISTANCE_METERS} THEN 'HIGH' ELSE 'MEDIUM' END"
GPS_FOUND = (f"gps_d AS (SELECT *, {_D} AS d FROM gps_m WHERE n >= 3),\n"
             f"gps_found AS (SELECT visit_id, employee_code, store_code, store_name, username, visit_date, year_num, month_num, "
             f"latitude AS visit_latitude, longitude AS visit_longitude, median_latitude, median_longitude, "
             f"CAST(n AS BIGINT) AS total_visits_in_group, {rdec('d', 2)} AS distance_meters, {rdec('d / 1000', 3)} AS distance_km, "
             f"{_SEV} AS severity, CAST(visit_id AS VARCHAR) AS entity_id, "
             f"'visit_gps=(' || CAST(latitude AS VARCHAR) || ',' || CAST(longitude AS VARCHAR) || ')' AS actual_value, "
             f"'monthly_cluster_gps=(' || CAST(CAST(round(median_latitude, 6) AS DECIMAL(10,6)) AS VARCHAR) || ',' "
             f"|| CAST(CAST(round(median_longitude, 6) AS DECIMAL(10,6)) AS VARCHAR) || ')' AS expected_value, "
             f"{_SEV} || ': GPS check-in for ' || employee_code || ' at store ' || store_code || ' (' "
             f"|| coalesce(store_name, 'Unknown store') || ') on ' || strftime(visit_date, '%Y-%m-%d') || ' is ' "
             f"|| CAST({rdec('d', 0, 20)} AS VARCHAR) || ' meters (' || CAST({rdec('d / 1000', 2, 20)} AS VARCHAR) "
             f"|| ' km) away from the normal monthly GPS zone. This store was visited ' || CAST(n AS VARCHAR) "
             f"|| ' times by the same merchandiser in ' || CAST(year_num AS VARCHAR) || '-' "
             f"|| lpad(CAST(month_num AS VARCHAR), 2, '0') || '.' AS message "
             f"FROM gps_d WHERE d > {GPS_WARNING_DISTANCE_METERS} {{scope}})")

FINDING_COLS = ("run_id, rule_code, entity_type, entity_id, visit_id, store_code, employee_code, product_code, "
                "question, actual_value, expected_value, metric_value, message, severity")


def findings_cte(out: str, run_id: int, osa: str, gps: str) -> str:
    return (f"{out} AS (SELECT CAST({run_id} AS BIGINT) AS run_id, '{OSA_RULE_CODE}' AS rule_code, "
            f"'survey_response' AS entity_type, entity_id, CAST(visit_id AS BIGINT) AS visit_id, store_code, "
            f"employee_code, product_code, question, response AS actual_value, 'Oui' AS expected_value, "
            f"CAST(availability_rate AS DECIMAL(12,4)) AS metric_value, message, 'MEDIUM' AS severity, "
            f"banner, yes_count, no_count, total_answers, availability_rate, NULL AS distance_meters FROM {osa} "
            f"UNION ALL SELECT CAST({run_id} AS BIGINT), '{GPS_RULE_CODE}', 'visit', entity_id, "
            f"CAST(visit_id AS BIGINT), store_code, employee_code, NULL, '{GPS_RULE_QUESTION}', actual_value, "
            f"expected_value, CAST(distance_meters AS DECIMAL(12,4)), message, severity, NULL, NULL, NULL, NULL, "
            f"NULL, distance_meters FROM {gps})")


RULES = SURV + [OSA_BASE, OSA_WEEKLY.format(base="osa_base"), OSA_FOUND.format(base="osa_base", scope=""),
                GPS_ROWS, GPS_MED.format(rows="gps"), GPS_FOUND.format(scope="")]

# Scoped run: afternoon-delivered visits (single-load ids); baselines use all history.
SCOPED = [
    "target AS (SELECT v.visit_id FROM vis v WHERE EXISTS (SELECT 1 FROM src s WHERE hour(s.responsedate) >= 12 "
    f"AND s.visit_date = v.visit_date AND {ct('s.employee_code')} = v.employee_code AND {ct('s.store_code')} = v.store_code))",
    OSA_FOUND.format(base="osa_base", scope="AND b.visit_id IN (SELECT visit_id FROM target)").replace("osa_found AS", "osa_found2 AS"),
    GPS_FOUND.format(scope="AND visit_id IN (SELECT visit_id FROM target)")
    .replace("gps_d AS", "gps_d2 AS").replace("gps_found AS", "gps_found2 AS").replace("FROM gps_d WHERE", "FROM gps_d2 WHERE"),
    findings_cte("f1", 1, "osa_found", "gps_found"),
    findings_cte("f2", 2, "osa_found2", "gps_found2"),
    "findings AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2)",
]
ALL_RUNS = RULES + SCOPED

PHOTO_TABLES = ["task_location_checkin", "task_price", "task_primary_shelf_placement"]
PHOTO_COLS = ["q_photo_click", "q_photo_error", "q_photo_purchase", "q_photo_signup", "q_photo_view"]


def wide_select(table: str, keys: list[str], cols: list[str], title: bool = False, location: bool = False) -> str:
    """Wide task table as one grouped SELECT over ``tagged``."""
    items = list(keys)
    if title:
        items.append(f"arg_min({strip('title')}, src_ordinal) AS title")
    if location:
        items.append("CAST(arg_min(latitude, src_ordinal) AS DECIMAL(10,6)) AS latitude")
        items.append("CAST(arg_min(longitude, src_ordinal) AS DECIMAL(10,6)) AS longitude")
    items.append("CAST(arg_min(responsedate, src_ordinal) AS DATE) AS response_date")
    items += [f"arg_max_null({ct('response')}, src_ordinal) FILTER (WHERE qcol = '{c}') AS {c}" for c in cols]
    inner = (f"SELECT *, {strip('task')} AS task_key, {q2c(ct('question'))} AS qcol FROM tagged "
             f"WHERE target_table = '{table}'")
    agg = f"SELECT {', '.join(items)} FROM ({inner}) GROUP BY {', '.join(keys)}"
    outs = ["visit_id"] + (["product_id"] if "product_id" in keys else []) + (["title"] if title else []) \
        + (["task_key AS task"] if "task_key" in keys else [])
    if location:
        outs += ["latitude", "longitude", f"{link('latitude', 'longitude')} AS map_link"]
    outs += ["response_date"] + cols
    return f"SELECT {', '.join(outs)} FROM ({agg})"


def wide_sql(table: str, keys: list[str], cols: list[str], title: bool = False, location: bool = False) -> str:
    return with_(*TAG) + wide_select(table, keys, cols, title, location)


SOS_SQL = with_(*TAG, (
    "sos_rows AS (SELECT visit_id, src_ordinal, responsedate, q AS qst, v AS qst_value, t AS task, "
    "coalesce(contains(upper(q), 'UNILEVER SOS'), false) AS is_close, "
    "coalesce(contains(upper(q), 'TOTAL'), false) AND NOT coalesce(contains(upper(q), 'UNILEVER SOS'), false) AS is_total "
    f"FROM (SELECT *, {ct('question')} AS q, {ct('response')} AS v, {ct('task')} AS t FROM tagged "
    "WHERE target_table = 'task_sos'))"),
    ("numbered AS (SELECT *, coalesce(sum(CAST(is_close AS INTEGER)) OVER (PARTITION BY visit_id ORDER BY src_ordinal "
     "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM sos_rows)"),
    ("blocks AS (SELECT visit_id, blk, max(CAST(is_close AS INTEGER)) AS closed, "
     "arg_max_null(qst_value, src_ordinal) FILTER (WHERE is_close) AS close_value, "
     "arg_max_null(qst_value, src_ordinal) FILTER (WHERE is_total) AS running_total FROM numbered GROUP BY visit_id, blk)"),
    "vdate AS (SELECT visit_id, CAST(arg_min(responsedate, src_ordinal) AS DATE) AS response_date FROM sos_rows GROUP BY visit_id)",
) + ("SELECT n.visit_id, n.task, d.response_date, n.qst, n.qst_value, "
     "coalesce(NULLIF(regexp_extract(b.close_value, '\\$\\s*([0-9]+(?:\\.[0-9]+)?)', 1), ''), b.running_total) AS total "
     "FROM numbered n JOIN blocks b ON b.visit_id = n.visit_id AND b.blk = n.blk JOIN vdate d ON d.visit_id = n.visit_id "
     "WHERE b.closed = 1 AND n.qst IS NOT NULL AND NOT n.is_close AND NOT n.is_total")

DEVIATION_WIDE = wide_sql("task_callcycle_deviation", ["visit_id"], ["q_callcycle_deviation"])


def _legacy() -> str:
    return ("legacy AS (SELECT visit_id AS validation_id, rule_code, visit_id, store_code, employee_code, product_code, "
            "question, actual_value AS response, message, banner, yes_count, no_count, total_answers, "
            "availability_rate FROM f1)")


_DIST = ("coalesce(NULLIF(regexp_extract(coalesce(response, ''), 'distance_meters=(\\d+(?:\\.\\d+)?)', 1), ''), "
         "NULLIF(regexp_extract(coalesce(response, ''), 'is (\\d+(?:\\.\\d+)?) meters', 1), ''), "
         "NULLIF(regexp_extract(coalesce(message, ''), 'distance_meters=(\\d+(?:\\.\\d+)?)', 1), ''), "
         "NULLIF(regexp_extract(coalesce(message, ''), 'is (\\d+(?:\\.\\d+)?) meters', 1), ''))")


def deliveries(kept: str) -> list[str]:
    """Base tables of some of three deliveries, each moved by 100 days, loaded in their order."""
    moved = ("src AS (SELECT * REPLACE (CAST(visit_date + CAST(100 * (src_ordinal % 3) AS INTEGER) AS DATE) AS visit_date, "
             f"src_ordinal + 1000000000000 * (src_ordinal % 3) AS src_ordinal) FROM delivered WHERE src_ordinal % 3 IN ({kept}))")
    return [SRC.replace("src AS", "delivered AS", 1), moved, first_load("", "src")]


STORED = " UNION ALL ".join([
    "SELECT 'employees' AS table_name, 'all' AS month, count(*) AS n_rows, max(employee_id) AS max_id FROM emp",
    "SELECT 'stores', 'all', count(*), max(store_id) FROM sto", "SELECT 'products', 'all', count(*), max(product_id) FROM pro",
    "SELECT 'visits', strftime(visit_date, '%Y-%m'), count(*), max(visit_id) FROM vis GROUP BY ALL",
    *(f"SELECT '{name}', strftime(v.visit_date, '%Y-%m'), count(*), max(v.visit_id) FROM survey_t s JOIN vis v ON v.visit_id = s.visit_id "
      f"WHERE s.question IS {test} GROUP BY ALL" for name, test in (("survey_responses", "NOT NULL"), ("survey_quarantine", "NULL")))])
CURRENT_RULES = [(OSA_RULE_CODE, OSA_RULE_NAME, OSA_RULE_DESCRIPTION, OSA_SOURCE_TABLE, OSA_SEVERITY),
                 (GPS_RULE_CODE, GPS_RULE_NAME, GPS_RULE_DESCRIPTION, GPS_SOURCE_TABLE, GPS_SEVERITY)]


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    src_cols = ("src_ordinal, visit_date, responsedate, year, month, employee_code, username, store_code, store_name, "
                "store_city, CAST(NULL AS VARCHAR) AS store_state, store_region, store_format, product_code, "
                "CAST(NULL AS VARCHAR) AS barcode, CAST(NULL AS VARCHAR) AS product_description, "
                "CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS sub_category, "
                "latitude, longitude, task, title, question, response")
    serial = "CAST(printf('%.12f', CAST(epoch_us(responsedate) AS DOUBLE) / 86400000000.0 + 25569.0) AS DOUBLE)"
    exported = [
        ("src_ordinal,", "row_number() OVER (ORDER BY src_ordinal) AS src_ordinal,"),
        ("responsedate,", f"make_timestamp(CAST(round(({serial} - 25569) * 86400000000) AS BIGINT)) AS responsedate,"),
        ("question, response", "question, CASE WHEN src_ordinal % 17 = 0 THEN response || chr(10) || 'suite \"2\", fin' ELSE response END AS response")]
    cols = src_cols
    for old, new in exported:
        cols = cols.replace(old, new, 1)
    q["scan_export"] = with_(SRC) + f"SELECT {cols} FROM src"
    ymd = "strftime(responsedate, '%Y%m%d')"
    raw = (f"CASE WHEN src_ordinal % 17 = 0 THEN {ymd} || '.0' WHEN src_ordinal % 19 = 0 "
           f"THEN substr({ymd}, 1, 4) || '13' || substr({ymd}, 7, 2) ELSE {ymd} END")
    q["parse_dateid"] = with_(SRC) + (f"SELECT src_ordinal, dateid, CAST(try_strptime({ct('dateid')}, '%Y%m%d') AS DATE) "
                                     f"AS visit_date FROM (SELECT src_ordinal, {raw} AS dateid FROM src)")
    q["parse_excel_serial"] = with_(SRC, (
        "s AS (SELECT src_ordinal, CAST(epoch_us(responsedate) AS DOUBLE) / 86400000000.0 + 25569.0 AS serial FROM src)"),
        "p AS (SELECT src_ordinal, serial, make_timestamp(CAST(round((serial - 25569) * 86400000000) AS BIGINT)) AS responsedate FROM s)",
    ) + f"SELECT src_ordinal, serial, responsedate, {rts('responsedate')} AS response_datetime FROM p"
    q["clean_text"] = with_(SRC) + "SELECT src_ordinal, " + ", ".join(
        f"{ct(c)} AS {c}" for c in ["username", "store_name", "store_format", "task", "title", "question", "response"]) + " FROM src"
    q["clean_float"] = with_(SRC) + f"SELECT src_ordinal, response, {cfloat('response')} AS response_number FROM src"
    q["question_to_column"] = with_(SRC) + (
        f"SELECT question, {q2c('question')} AS question_col FROM (SELECT DISTINCT {ct('question')} AS question FROM src) "
        "WHERE question IS NOT NULL")
    q["week_mode1"] = with_(SRC) + (
        f"SELECT src_ordinal, response_datetime, CAST(year(response_datetime) AS INTEGER) AS year_num, {week1('response_datetime')} AS week_num "
        f"FROM (SELECT src_ordinal, {rts('responsedate')} AS response_datetime FROM src)")

    sa, pa = ", ".join(STORE_ATTRS), ", ".join(PRODUCT_ATTRS)
    q["build_employees"] = with_(*BASE) + "SELECT employee_code, username FROM empb"
    q["build_stores"] = with_(*BASE) + f"SELECT store_code, {sa} FROM stob"
    q["build_products"] = with_(*BASE) + f"SELECT product_code, {pa} FROM prob"
    q["build_visits"] = with_(*BASE) + "SELECT visit_date, employee_code, store_code, year, month, latitude, longitude, map_link FROM visb"
    TWO = [SRC, second_load()]
    q["merge_employees"] = with_(*TWO) + "SELECT employee_id, employee_code, username FROM emp2"
    q["merge_stores"] = with_(*TWO) + f"SELECT store_id, store_code, {sa} FROM sto2"
    q["merge_products"] = with_(*TWO) + f"SELECT product_id, product_code, {pa} FROM pro2"
    q["merge_visits"] = with_(*TWO) + ("SELECT visit_id, visit_date, year, month, employee_id, store_id, employee_code, "
                                       "store_code, latitude, longitude, map_link FROM vis2")
    q["semi_target"] = with_(*TWO) + "SELECT visit_id FROM affected"
    q["visit_lookup"] = with_(*BASE) + "SELECT visit_id, visit_date, employee_code, store_code FROM lk"

    q["filter_store_format"] = with_(SRC) + (
        f"SELECT src_ordinal, store_format FROM src WHERE NOT coalesce(upper({strip('store_format')}) IN ('GROCERY', 'ICE CREAM'), false)")
    q["build_survey"] = with_(*SURV) + "SELECT * FROM survey_t"
    q["replace_by_visit"] = with_(SRC, second_load(), survey("s1", "d1", "lk1"), survey("s2", "d2", "lk2")) + (
        "SELECT * FROM s1 WHERE visit_id NOT IN (SELECT visit_id FROM affected) UNION ALL SELECT * FROM s2")

    q["delete_visit_payload"] = with_(SRC, second_load(), survey("s1", "d1", "lk1")) + (
        "SELECT * FROM s1 WHERE visit_id NOT IN (SELECT visit_id FROM affected)")

    q["route_task_table"] = with_(SRC, ROUTED) + "SELECT src_ordinal, target_table FROM routed WHERE target_table IS NOT NULL"
    q["unmatched_rows"] = with_(SRC, ROUTED) + "SELECT src_ordinal, task, title FROM routed WHERE target_table IS NULL"
    q["filter_glace"] = with_(SRC, ROUTED) + (
        f"SELECT src_ordinal, task, target_table FROM routed WHERE target_table = '{GLACE_TABLE}' "
        f"AND coalesce(contains(upper(task), '{GLACE_KEYWORD}'), false)")
    q["tag_task_rows"] = with_(*TAG) + "SELECT src_ordinal, target_table, visit_id, product_id FROM tagged"
    flags = lambda s: "target_table IN (" + ", ".join(f"'{t}'" for t in sorted(s)) + ")"
    from ..constants import LOCATION_TABLES, TABLES_WITH_PRODUCT, TABLES_WITH_TASK, TABLES_WITH_TITLE
    q["batch_task_tables"] = with_(*TAG) + (
        f"SELECT target_table, CAST(count(*) AS BIGINT) AS n_rows, CASE WHEN target_table = 'task_sos' THEN NULL "
        f"ELSE CAST(count(DISTINCT {ct('question')}) AS BIGINT) END AS n_questions, "
        f"{flags(TABLES_WITH_PRODUCT)} AS has_product, {flags(TABLES_WITH_TITLE)} AS has_title, "
        f"{flags(TABLES_WITH_TASK)} AS has_task, {flags(LOCATION_TABLES)} AS has_location_meta "
        "FROM tagged GROUP BY target_table")
    q["question_suffix"] = with_(*TAG, (
        f"d AS (SELECT DISTINCT target_table, {ct('question')} AS question FROM tagged WHERE target_table <> 'task_sos')"),
        f"b AS (SELECT *, {q2c('question')} AS base_col FROM d WHERE question IS NOT NULL)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY target_table, base_col ORDER BY question) AS k FROM b)",
    ) + "SELECT target_table, question, CASE WHEN k = 1 THEN base_col ELSE base_col || '_' || CAST(k AS VARCHAR) END AS question_col FROM r"
    q["pivot_questions"] = wide_sql("task_location_checkin", ["visit_id"], PHOTO_COLS, location=True)
    q["pivot_osa"] = wide_sql("task_osa_pack_coc_mh", ["visit_id", "product_id"], ["q_produit_disponible"], title=True)
    q["pivot_price"] = wide_sql("task_price", ["visit_id", "product_id"], PHOTO_COLS)
    q["pivot_shelf"] = wide_sql("task_primary_shelf_placement", ["visit_id", "task_key"], PHOTO_COLS)
    q["pivot_deviation"] = DEVIATION_WIDE
    q["task_answers"] = with_(*TAG) + (
        f"SELECT visit_id, product_id, question, arg_max_null({ct('response')}, src_ordinal) AS response "
        f"FROM (SELECT *, {ct('question')} AS question FROM tagged WHERE target_table = 'task_osa_pack_coc_mh') "
        "WHERE question IS NOT NULL GROUP BY visit_id, product_id, question")
    q["sos_blocks"] = SOS_SQL
    q["deviation_summary"] = with_(*TAG, f"dw AS ({wide_select('task_callcycle_deviation', ['visit_id'], ['q_callcycle_deviation'])})") + (
        "SELECT e.employee_id, e.employee_code, e.username, "
        "CAST(sum(CASE WHEN t.q_callcycle_deviation = 'Non' THEN 1 ELSE 0 END) AS BIGINT) AS completed_count, "
        "CAST(sum(CASE WHEN t.q_callcycle_deviation = 'Oui' THEN 1 ELSE 0 END) AS BIGINT) AS deviated_count, "
        "CAST(count(*) AS BIGINT) AS total_count FROM dw t JOIN vis v ON v.visit_id = t.visit_id "
        "JOIN emp e ON e.employee_id = v.employee_id GROUP BY e.employee_id, e.employee_code, e.username ORDER BY e.username")

    q["filter_osa_base"] = with_(*SURV, OSA_BASE) + (
        "SELECT visit_id, product_code, question, response, banner, year_num, week_num FROM osa_base")
    q["agg_osa_weekly"] = with_(*SURV, OSA_BASE, OSA_WEEKLY.format(base="osa_base")) + (
        "SELECT year_num, week_num, banner, product_code, question, total_answers, yes_count, no_count, "
        "CAST(availability_rate AS DOUBLE) AS availability_rate FROM osa_weekly")
    q["osa_unusual_non"] = with_(*RULES) + "SELECT * FROM osa_found"
    q["filter_gps_valid"] = with_(*BASE, GPS_ROWS) + (
        "SELECT visit_id, employee_code, store_code, year_num, month_num, latitude, longitude FROM gps")
    q["agg_gps_median"] = with_(*BASE, GPS_ROWS, GPS_MED.format(rows="gps")) + (
        "SELECT DISTINCT employee_code, store_code, year_num, month_num, CAST(n AS BIGINT) AS total_visits_in_group, "
        "median_latitude, median_longitude FROM gps_m")
    q["join_gps_cluster"] = with_(*BASE, GPS_ROWS, GPS_MED.format(rows="gps")) + (
        f"SELECT visit_id, CAST(n AS BIGINT) AS total_visits_in_group, median_latitude, median_longitude, "
        f"{rdec(_D, 2)} AS distance_meters FROM gps_m")
    q["gps_inconsistent"] = with_(*RULES) + "SELECT * FROM gps_found"
    q["union_findings"] = with_(*ALL_RUNS) + f"SELECT {FINDING_COLS} FROM f1"
    q["target_scope"] = with_(*ALL_RUNS) + f"SELECT {FINDING_COLS} FROM f2"
    q["details_osa"] = with_(*RULES) + (
        "SELECT visit_id, entity_id, banner, 'Oui' AS weekly_expected_response, yes_count, no_count, total_answers, "
        "availability_rate FROM osa_found")
    q["details_gps"] = with_(*RULES) + (
        "SELECT visit_id, strftime(visit_date, '%Y-%m-%d') AS visit_date, store_name, username, "
        "CAST(year_num AS INTEGER) AS year_num, CAST(month_num AS INTEGER) AS month_num, "
        "CAST(visit_latitude AS DOUBLE) AS visit_latitude, CAST(visit_longitude AS DOUBLE) AS visit_longitude, "
        "CAST(median_latitude AS DOUBLE) AS median_latitude, CAST(median_longitude AS DOUBLE) AS median_longitude, "
        "CAST(distance_meters AS DOUBLE) AS distance_meters, CAST(distance_km AS DOUBLE) AS distance_km, "
        f"total_visits_in_group, {GPS_WARNING_DISTANCE_METERS} AS warning_threshold_meters, "
        f"{GPS_HIGH_DISTANCE_METERS} AS high_threshold_meters FROM gps_found")

    q["issue_count_by_rule"] = with_(*ALL_RUNS) + "SELECT rule_code, CAST(count(*) AS BIGINT) AS issue_count FROM findings GROUP BY rule_code"
    q["issue_count_by_run_rule"] = with_(*ALL_RUNS) + (
        "SELECT run_id, rule_code, CAST(count(*) AS BIGINT) AS issue_count FROM findings GROUP BY run_id, rule_code "
        "ORDER BY run_id DESC, rule_code")
    q["issue_count_by_banner"] = with_(*ALL_RUNS) + (
        f"SELECT banner, CAST(count(*) AS BIGINT) AS issue_count FROM findings WHERE rule_code = '{OSA_RULE_CODE}' "
        "GROUP BY banner ORDER BY issue_count DESC, banner")
    tie = ("run_id DESC, rule_code ASC NULLS FIRST, visit_id ASC NULLS FIRST, entity_id ASC NULLS FIRST, "
           "question ASC NULLS FIRST, actual_value ASC NULLS FIRST, message ASC NULLS FIRST")
    q["latest_results"] = with_(*ALL_RUNS) + f"SELECT {FINDING_COLS} FROM findings ORDER BY {tie} LIMIT 20"
    q["rule_results_view"] = with_(*ALL_RUNS) + (
        "SELECT run_id, rule_code, entity_type, entity_id, visit_id, store_code, employee_code, product_code, question, "
        "actual_value, expected_value, metric_value, severity, message, banner, yes_count, no_count, total_answers, "
        f"CAST(availability_rate AS DOUBLE) AS availability_rate FROM findings WHERE rule_code = '{OSA_RULE_CODE}' "
        f"ORDER BY {tie} LIMIT 20")
    q["gps_results_sorted"] = with_(*ALL_RUNS) + (
        f"SELECT {FINDING_COLS} FROM findings WHERE rule_code = '{GPS_RULE_CODE}' ORDER BY metric_value DESC, run_id DESC, visit_id")
    q["gps_results_report"] = with_(*ALL_RUNS) + (
        "SELECT f.run_id, f.rule_code, f.severity, f.employee_code, e.username, f.store_code, s.store_name, f.visit_id, "
        "v.visit_date, CAST(f.distance_meters AS DECIMAL(12,2)) AS distance_meters, "
        "CAST(round(CAST(f.distance_meters AS DECIMAL(12,2)) / 1000, 2) AS DECIMAL(12,2)) AS distance_km, f.message "
        "FROM findings f LEFT JOIN emp e ON e.employee_code = f.employee_code LEFT JOIN sto s ON s.store_code = f.store_code "
        f"LEFT JOIN vis v ON v.visit_id = f.visit_id WHERE f.rule_code = '{GPS_RULE_CODE}' "
        "ORDER BY distance_meters DESC, f.run_id, f.visit_id")
    q["stores_banner_list"] = with_(*BASE) + f"SELECT store_name, {banner('store_name')} AS banner FROM sto ORDER BY store_name"
    q["table_counts"] = with_(*SURV) + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}"
        for n, t in [("employees", "emp"), ("stores", "sto"), ("products", "pro"), ("visits", "vis"),
                     ("survey_responses", "survey_t")])
    q["run_log"] = with_(*ALL_RUNS) + (
        "SELECT run_id, 'SUCCESS' AS status, CAST(2 AS INTEGER) AS rules_executed, CAST(count(*) AS BIGINT) AS issues_found "
        "FROM findings GROUP BY run_id ORDER BY run_id DESC")
    q["list_employees"] = with_(*BASE) + "SELECT employee_id, employee_code, username FROM emp"
    q["etl_run"] = with_(*deliveries("0, 1, 2"), survey("survey_t", "src", "lk")) + STORED
    q["full_refresh"] = with_(*deliveries("1"), survey("survey_t", "src", "lk")) + STORED
    from ..operators.routing import table_flags
    month = "strftime(visit_date, '%Y-%m')"
    keyed = []
    for t in sorted(set(TASK_TABLE_MAP.values()) | set(TITLE_TABLE_MAP.values())):
        if t != "task_sos":
            flag = table_flags(t)
            keyed.append((t, ["visit_id"] + ["product_id"] * flag["has_product"] + [strip("task")] * flag["has_task"]))
    wide = [f"SELECT '{t}' AS table_name, month, count(*) AS n_rows FROM (SELECT DISTINCT {month} AS month, {', '.join(keys)} "
            f"FROM tagged WHERE target_table = '{t}') GROUP BY month" for t, keys in keyed]
    answers = " UNION ALL ".join(
        f"SELECT DISTINCT {month} AS month, '{t}' AS t, visit_id, {'product_id' if 'product_id' in keys else 'NULL'} AS p, "
        f"{strip('task') if len(keys) > 1 and 'product_id' not in keys else 'NULL'} AS k, {ct('question')} AS qu FROM tagged "
        f"WHERE target_table = '{t}' AND {ct('question')} IS NOT NULL" for t, keys in keyed)
    sos = SOS_SQL[SOS_SQL.index("sos_rows AS"):]
    cut = sos.index("SELECT n.visit_id, n.task")
    q["load_task_tables"] = with_(*deliveries("0, 1"), ROUTED, TAGGED, sos[:cut].rstrip(), f"sos AS ({sos[cut:]})") + " UNION ALL ".join([
        *wide, f"SELECT 'task_answers', month, count(*) FROM ({answers}) GROUP BY month",
        f"SELECT 'task_sos', {month.replace('visit_date', 'v.visit_date')}, count(*) FROM sos JOIN vis v ON v.visit_id = sos.visit_id GROUP BY ALL"])
    q["evolve_question_columns"] = q["question_suffix"]
    fixed = []
    for t, _ in keyed:
        flag = table_flags(t)
        names = (["visit_id"] + ["product_id"] * flag["has_product"] + ["title"] * flag["has_title"] + ["task"] * flag["has_task"]
                 + ["latitude", "longitude", "map_link"] * flag["has_location_meta"] + ["response_date", "visit_month"])
        fixed += [(t, n) for n in names]
    fixed += [("task_answers", n) for n in ("visit_id", "target_table", "product_id", "task_key", "question", "response", "visit_month")]
    fixed += [("task_sos", n) for n in ("visit_id", "task", "response_date", "qst", "qst_value", "total", "visit_month")]
    values = ", ".join(f"('{t}', '{n}')" for t, n in fixed)
    first = "CAST(min(CASE WHEN src_ordinal < 1000000000000 THEN 1 ELSE 2 END) AS INTEGER)"
    given = "given AS (SELECT * FROM tagged WHERE src_ordinal >= 1000000000000 OR NOT coalesce(contains(question, 'purchase'), false))"
    q["evolve_task_schema"] = with_(*deliveries("0, 1"), ROUTED, TAGGED, given, f"fixed(t, n) AS (VALUES {values})") + (
        f"SELECT target_table AS table_name, {q2c(ct('question'))} AS column_name, {first} AS delivery FROM given "
        f"WHERE target_table <> 'task_sos' AND {ct('question')} IS NOT NULL GROUP BY ALL UNION ALL "
        f"SELECT f.t, f.n, {first} FROM fixed f JOIN given ON f.t = target_table OR (f.t = 'task_answers' AND target_table <> 'task_sos') GROUP BY ALL")
    q["rules_by_code"] = " UNION ALL ".join(
        "SELECT " + ", ".join("'" + v.replace("'", "''") + f"' AS {n}" for v, n in zip(r, ["rule_code", "rule_name", "description", "source_table", "severity"]))
        + ", true AS is_active" for r in CURRENT_RULES)

    mig = with_(*ALL_RUNS, _legacy(), f"lg AS (SELECT *, CAST({_DIST} AS DOUBLE) AS dist FROM legacy)")
    osa = f"rule_code = '{OSA_RULE_CODE}'"
    q["migrate_results"] = mig + (
        f"SELECT CAST(3 AS BIGINT) AS run_id, rule_code, CASE WHEN {osa} THEN 'survey_response' ELSE 'visit' END AS entity_type, "
        f"CASE WHEN {osa} THEN (CASE WHEN visit_id IS NOT NULL AND product_code IS NOT NULL AND product_code <> '' "
        "THEN CAST(visit_id AS VARCHAR) || ':' || product_code WHEN visit_id IS NOT NULL THEN CAST(visit_id AS VARCHAR) "
        "ELSE product_code END) ELSE CAST(visit_id AS VARCHAR) END AS entity_id, visit_id, store_code, employee_code, "
        f"product_code, question, response AS actual_value, CASE WHEN {osa} THEN 'Oui' END AS expected_value, "
        "CAST(coalesce(CAST(availability_rate AS DOUBLE), dist) AS DECIMAL(12,4)) AS metric_value, message, "
        "CASE WHEN contains(upper(coalesce(banner, '')), 'CRITICAL') OR contains(upper(coalesce(banner, '')), 'HIGH') "
        "OR contains(upper(coalesce(message, '')), 'CRITICAL:') OR contains(upper(coalesce(message, '')), 'HIGH:') "
        "THEN 'HIGH' ELSE 'MEDIUM' END AS severity, banner AS legacy_banner, "
        "CAST(availability_rate AS DOUBLE) AS legacy_availability_rate, dist AS distance_meters, 'true' AS migrated_flag FROM lg")
    q["mig_rule_meta"] = mig + (
        "SELECT rule_code, rule_code AS rule_name_fallback FROM (SELECT DISTINCT rule_code FROM legacy)")
    from ..operators.migrate import KNOWN_RULES
    from ..constants import LEGACY_UNKNOWN_DESCRIPTION, LEGACY_UNKNOWN_SEVERITY, LEGACY_UNKNOWN_SOURCE_TABLE
    known = " UNION ALL ".join(
        "SELECT " + ", ".join("'" + v.replace("'", "''") + "'" + f" AS {n}" for v, n in
                              zip(r, ["rule_code", "rule_name", "description", "source_table", "severity"]))
        for r in KNOWN_RULES)
    q["mig_rule_meta"] = mig + (
        f"SELECT c.rule_code, coalesce(k.rule_name, c.rule_code) AS rule_name, "
        f"coalesce(k.description, '{LEGACY_UNKNOWN_DESCRIPTION}') AS description, "
        f"coalesce(k.source_table, '{LEGACY_UNKNOWN_SOURCE_TABLE}') AS source_table, "
        f"coalesce(k.severity, '{LEGACY_UNKNOWN_SEVERITY}') AS severity, true AS is_active "
        f"FROM (SELECT DISTINCT rule_code FROM legacy) c LEFT JOIN ({known}) k ON k.rule_code = c.rule_code")
    q["distinct_rule_codes"] = mig + "SELECT rule_code, CAST(count(*) AS BIGINT) AS row_count FROM legacy GROUP BY rule_code"
    q["migration_run"] = (
        f"SELECT 'validation_results' AS table_name, rule_code, severity, count(*) AS n, CAST(sum(metric_value) AS DOUBLE) AS metric "
        f"FROM ({q['migrate_results']}) GROUP BY rule_code, severity UNION ALL "
        f"SELECT 'validation_rules', rule_code, severity, CAST(1 AS BIGINT), NULL FROM ({q['mig_rule_meta']}) UNION ALL "
        f"SELECT 'validation_run_log', 'MIGRATED', CAST(count(*) AS VARCHAR), CAST(sum(row_count) AS BIGINT), NULL FROM ({q['distinct_rule_codes']})")
    return q
