"""Optional case-insensitive text comparison in the OSA rule."""

import datetime as dt

from shelfscan.operators import rules


def test_osa_collation(spark):
    t = dt.datetime(2024, 1, 10, 9)
    rows = []
    for i in range(12):
        resp = "Oui" if i < 9 else ("non" if i == 9 else "Non")
        rows.append((i + 1, "E1", "S1", "P1", "t", "Osa", "Produit DISPONIBLE", resp, t, None, None))
    survey = spark.createDataFrame(rows, "visit_id bigint, employee_code string, store_code string, product_code string, "
                                         "task string, title string, question string, response string, "
                                         "response_datetime timestamp_ntz, latitude decimal(10,6), longitude decimal(10,6)")
    stores = spark.createDataFrame([("S1", "Marjane")], "store_code string, store_name string")
    exact = rules.osa_unusual_non(survey, stores).collect()
    # exact: 'non' is not an answer; 11 answers, 9 Oui -> 81.82 % -> the two 'Non' rows are flagged
    assert sorted(r.visit_id for r in exact) == [11, 12] and exact[0].total_answers == 11
    ci = rules.osa_unusual_non(survey, stores, collation="UNICODE_CI_AI").collect()
    # collated: 12 answers, 9 Oui -> 75 % -> below 80, nothing flagged
    assert ci == []
