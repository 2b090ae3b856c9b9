"""Order-dependent operators against small pure-Python state machines."""

import datetime as dt
from decimal import Decimal as D
import random
import re

from pyspark.sql import functions as F

from shelfscan.operators import pivot, sos
from shelfscan.operators.scan import prefix_count

TAGGED_SCHEMA = ("visit_id bigint, product_id bigint, src_ordinal bigint, responsedate timestamp_ntz, "
                 "task string, title string, question string, response string, latitude decimal(10,6), "
                 "longitude decimal(10,6), target_table string")


def clean(v):
    if v is None:
        return None
    t = v.strip()
    return t or None


def sos_machine(rows):
    """A visit's answered rows, cut after every row that names UNILEVER SOS: each
    finished piece gives its plain rows with the dollar amount of its closing
    row, or else with the answer of its last TOTAL row."""
    def kind(r):
        name = clean(r[6]).upper()
        return "close" if "UNILEVER SOS" in name else "total" if "TOTAL" in name else "brand"

    out = []
    for visit in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == visit), key=lambda r: r[2])
        day = next((r[3].date() for r in ordered if r[3] is not None), None)
        answered = [r for r in ordered if clean(r[6])]
        ends = [i for i, r in enumerate(answered) if kind(r) == "close"]
        for begin, end in zip([0] + [e + 1 for e in ends], ends):
            piece = answered[begin:end]
            amount = re.findall(r"\$\s*(\d+(?:\.\d+)?)", clean(answered[end][7]) or "")
            totals = [clean(r[7]) for r in piece if kind(r) == "total"]
            whole = amount[0] if amount else (totals or [None])[-1]
            out.extend((visit, clean(r[4]), day, clean(r[6]), clean(r[7]), whole) for r in piece if kind(r) == "brand")
    return sorted(out, key=repr)


def random_sos_rows(seed, n_visits=60):
    rnd = random.Random(seed)
    qs = ["TOTAL lineaire", "Total UNILEVER SOS", "Marque A", "Marque B", None, " total x ", "unilever sos 2"]
    resp = ["$ 12", "$3.5", "7", None, "  ", "x $ 9 y", "abc"]
    rows, ordinal = [], 0
    for v in range(n_visits):
        for _ in range(rnd.randint(0, 25)):
            ordinal += rnd.randint(1, 3)
            ts = None if rnd.random() < 0.2 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=ordinal)
            rows.append((v, None, ordinal, ts, rnd.choice(["AUDIT", " SOS ", None]), "Sos audit",
                         rnd.choice(qs), rnd.choice(resp), None, None, "task_sos"))
    rnd.shuffle(rows)
    return rows


def test_sos_blocks_matches_state_machine(spark):
    rows = random_sos_rows(7)
    df = spark.createDataFrame(rows, TAGGED_SCHEMA)
    for bucket in (4, 1 << 20):  # tiny buckets force the multi-bucket prefix path
        got = sorted((tuple(r) for r in sos.sos_blocks(df, bucket_size=bucket).collect()), key=repr)
        assert got == sos_machine(rows)


def test_prefix_count_buckets(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 5), i * 5 + rnd.randint(0, 4), rnd.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o bigint, f boolean")
    got = {(r.g, r.o): r.n for r in prefix_count(df, ["g"], "o", "f", "n", bucket_size=16).collect()}
    exp = {}
    for g in {r[0] for r in rows}:
        c = 0
        for _, o, f in sorted([r for r in rows if r[0] == g], key=lambda r: r[1]):
            exp[(g, o)] = c
            c += int(f)
    assert got == exp


def test_pivot_last_answer_wins_and_first_non_null(spark):
    t0 = dt.datetime(2024, 1, 2, 10)
    rows = [
        (1, None, 10, None, "x", None, "Photo A", "1", None, None, "task_location_checkin"),
        (1, None, 11, t0, "x", None, " Photo A", "2", D("33.5"), D("-7.6"), "task_location_checkin"),
        (1, None, 12, t0, "x", None, "Photo B", "b", D("33.6"), D("-7.7"), "task_location_checkin"),
        (1, None, 13, None, "x", None, "Photo A", "  ", None, None, "task_location_checkin"),  # later blank wins
        (2, None, 20, None, "x", None, None, "z", None, None, "task_location_checkin"),  # only a null question
    ]
    df = spark.createDataFrame(rows, TAGGED_SCHEMA)
    cols = pivot.dictionary_columns(spark, pivot.question_dictionary(df), "task_location_checkin")
    assert cols == {"Photo A": "q_photo_a", "Photo B": "q_photo_b"}
    wide = {r.visit_id: r for r in pivot.pivot_task_table(df, "task_location_checkin", cols).collect()}
    assert wide[1].q_photo_a is None and wide[1].q_photo_b == "b"
    assert float(wide[1].latitude) == 33.5 and wide[1].map_link == "https://www.google.com/maps?q=33.5,-7.6"
    assert wide[1].response_date == dt.date(2024, 1, 2)
    assert wide[2].q_photo_a is None and wide[2].response_date is None


def named(spark, bases, taken=()):
    df = spark.createDataFrame([([(q, b) for q, b in bases.items()], list(taken))],
                               "asked array<struct<question:string,base_col:string>>, taken array<string>")
    got = df.select(pivot.name_columns(F.col("asked"), F.col("taken")).alias("n")).first().n
    return {r.question: r.question_col for r in got}


def test_question_suffixes(spark):
    assert named(spark, {"a": "q_a", "a 2": "q_a_2", "a!": "q_a"}) == {"a": "q_a", "a 2": "q_a_2", "a!": "q_a_3"}
    long = "q_" + "x" * 62
    assert named(spark, {"x1": long, "x2": long}) == {"x1": long, "x2": long[:62] + "_2"}
    assert named(spark, {"b": "q_b"}, ["q_b"]) == {"b": "q_b_2"}
    assert named(spark, {f"n{i:02}": "q" for i in range(12)})["n11"] == "q_12"


def test_dictionary_keeps_known_columns(spark):
    rows = [(1, None, i, None, "t", None, q, "r", None, None, "task_quality")
            for i, q in enumerate(["a", "a!", "new?"])]
    df = spark.createDataFrame(rows, TAGGED_SCHEMA)
    known = spark.createDataFrame([("task_quality", "a!", "q_a")], pivot.DICTIONARY_SCHEMA)
    got = {r.question: r.question_col for r in pivot.question_dictionary(df, known).collect()}
    assert got == {"a": "q_a_2", "new?": "q_new"}


def _price_rows(*answers):
    """(visit, product, ordinal, task, question, response) as tagged rows of the price table."""
    return [(v, p, o, dt.datetime(2024, 1, 2, 3), task, "t", q, r, None, None, "task_price") for v, p, o, task, q, r in answers]


def test_two_thousand_questions_in_one_table(spark):
    """The number of columns adds no aggregate, and every answer finds its column."""
    n = 2_000
    rows = _price_rows(*((v, 1, v * n + i, None, f"question {i}", f"{v}-{i}") for v in (1, 2) for i in range(n) if (v + i) % 3))
    tagged = spark.createDataFrame(rows, TAGGED_SCHEMA)
    columns = {f"question {i}": f"q_question_{i}" for i in range(n)}
    wide = pivot.pivot_task_table(tagged, "task_price", columns)
    got = {r["visit_id"]: r.asDict() for r in wide.collect()}
    for v in (1, 2):
        assert all(got[v][f"q_question_{i}"] == (f"{v}-{i}" if (v + i) % 3 else None) for i in range(n))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("max_by") < 20


def test_tasks_that_differ_in_white_space_are_one_row(spark):
    """A row of the wide table is a task as the table shows it, without the white space around it."""
    from shelfscan.constants import TABLES_WITH_TASK

    table = sorted(TABLES_WITH_TASK)[0]
    rows = [(1, None, o, None, task, "t", "q", r, None, None, table) for o, task, r in ((1, " AUDIT", "a"), (2, "AUDIT", "b"), (3, "audit", "c"), (4, None, "d"))]
    got = pivot.pivot_task_table(spark.createDataFrame(rows, TAGGED_SCHEMA), table, {"q": "q_q"}).collect()
    assert sorted((r["task"] or "", r["q_q"]) for r in got) == [("", "d"), ("AUDIT", "b"), ("audit", "c")]


def test_routes_are_found_once_for_a_row(spark):
    """The rule is not evaluated again for the filters above it; null, blank and several titles keep their route."""
    from shelfscan.operators import routing

    rows = [("LOCATION CHECK IN", "Osa"), (" QUALITY\u3000", None), ("quality", "prix et sos"), (None, "Secondary placement"), ("bac GLACE", "secondary placement"),
            (None, None), ("AUDIT", "other"), ("", "temperature, osa")]
    src = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "src_ordinal bigint, task string, title string")
    kept = routing.filter_glace(routing.route_task_table(src))
    assert {r["src_ordinal"]: r["target_table"] for r in kept.collect()} == {
        0: "task_location_checkin", 1: "task_quality", 2: "task_price", 3: "task_secondary_placement", 7: "task_osa_pack_coc_mh"}
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("TEMPERATURE") == 1
    assert [r["src_ordinal"] for r in routing.unmatched_rows(src).orderBy("src_ordinal").collect()] == [5, 6]
