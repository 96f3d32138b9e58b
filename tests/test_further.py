import numpy as np

from tasklattice.functions import models
from tasklattice.functions import structured as S
from tasklattice.operators import exposure
from tasklattice.streaming import batches


def test_truncated():
    assert S.truncated('{"a": 1, } {"b": {"c": 2}} {"d": ') == '{"a": 1 } {"b": {"c": 2}}'
    assert S.truncated('[1, 2, ]') == "[1, 2 ]" and S.truncated('{"a": ') == '{"a": ' and S.truncated("") == ""


def test_semantic_majority_groups_alike_statements(spark):
    class Said:
        def __init__(self, seed):
            self.seed = seed

        def __call__(self, prompts):
            return ['["check the invoices now", "sort mail"]' if self.seed < 2 else '["check the invoices now please"]' for _ in prompts]

    df = spark.createDataFrame([(1, "x"), (2, None)], "uid int, t string")
    got = {tuple(r) for r in models.semantic_majority(df, "t", Said, models.HashedEmbedder(64)).collect()}
    assert got == {(u, "check the invoices now please", 5) for u in (1, 2)}


def test_a_stopped_run_goes_on(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i) for i in range(9)], "k int, v int")
    calls = []
    step = lambda x: calls.append(1) or x.groupBy("k").sum("v")
    batches.resumed(df, "k", [0, 1, 2], step, f"{tmp_path}/r", stop_after=2)
    rows = batches.resumed(df, "k", [0, 1, 2], step, f"{tmp_path}/r").collect()
    assert sorted(tuple(r) for r in rows) == [(0, 9), (1, 12), (2, 15)] and len(calls) == 3


def test_shares_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = sorted({tuple(int(x) for x in r) for r in np.column_stack((rng.integers(0, 4, 150), rng.integers(0, 9, 150), rng.integers(0, 5, 150), rng.integers(2015, 2020, 150)))})
    m = spark.createDataFrame(rows, "firm int, app int, task int, year int")
    for anywhere in (False, True):
        pairs = m.select("app", "task").distinct() if anywhere else None
        got = {(r.firm, r.year, r.task): (r.n_apps, r.n_matched) for r in exposure.firm_task_share(m, m.select("year").distinct(), pairs).collect()}
        want = {}
        for f in {r[0] for r in rows}:
            for y in range(2015, 2020):
                apps = {a for g, a, _, z in rows if g == f and z <= y}
                for t in range(5):
                    hit = sum(any(a == b and t == u and (anywhere or g == f) for g, b, u, _ in rows) for a in apps)
                    if hit:
                        want[f, y, t] = (len(apps), hit)
        assert got == want
    assert exposure.firm_task_share(m.limit(0), m.select("year").distinct()).count() == 0
