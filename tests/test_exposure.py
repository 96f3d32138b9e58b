"""Hand-derived numbers: two firms, two occupations, two years."""

import math

import pytest

from tasklattice.operators import exposure

JOBS = {"u1": ("A", 2020), "u2": ("A", 2020), "u3": ("A", 2021), "u4": ("B", 2020)}
APPS = [("App1", "u1"), ("App2", "u2"), ("App3", "u3"), ("App1", "u4")]
MATCHES = [("App1", "T1"), ("App2", "T1"), ("App3", "T2"), ("App1", "T3"), ("App2", "T4"), ("App3", "T4")]
WEIGHTS = [("O1", "T1", 4.0), ("O1", "T2", 3.0), ("O2", "T3", 5.0), ("O2", "T4", 2.0)]
WANT = {("A", 2020): (2, 4 / 7, 0.5), ("A", 2021): (3, (8 / 3 + 1) / 7, (5 / 3 + 4 / 3) / 7), ("B", 2020): (1, 4 / 7, 5 / 7), ("B", 2021): (1, 4 / 7, 5 / 7)}


@pytest.fixture(scope="module")
def result(spark):
    rows = [(*JOBS[u], a, t) for a, u in APPS for b, t in MATCHES if a == b]
    matches = spark.createDataFrame(rows, "firm string, year int, app string, task string")
    years = spark.createDataFrame([(2020,), (2021,)], "year int")
    weights = spark.createDataFrame(WEIGHTS, "occupation string, task string, weight double")
    return {(r.firm, r.year, r.occupation): r for r in exposure.occupation_exposure(exposure.firm_task_share(matches, years), weights).collect()}


def test_values(result):
    for (firm, year), (n, o1, o2) in WANT.items():
        for occ, want in (("O1", o1), ("O2", o2)):
            r = result[firm, year, occ]
            assert r.n_apps == n and r.occ_exposure == pytest.approx(want, rel=1e-9) and r.ai_exposure == pytest.approx(want * math.log(1 + n), rel=1e-9)
    assert len(result) == 8


def test_empty_and_weights(spark):
    empty = spark.createDataFrame([], "firm string, year int, app string, task string")
    assert exposure.firm_task_share(empty, spark.createDataFrame([(2020,)], "year int")).count() == 0
    w = exposure.normal_weights(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "g string, w double"), "g", "w").collect()
    assert sum(r.weight_norm for r in w if r.g == "a") == pytest.approx(1) and [r.weight_norm for r in w if r.g == "b"] == [1.0]
