import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tasklattice.functions import keywords as K
from tasklattice.functions import structured as S
from tasklattice.functions import text as T
from tasklattice.operators import dedup, estimators, panel, relational, sampling, similarity


def test_lag_only_over_consecutive_years(spark):
    df = spark.createDataFrame([(1, 2018, 1.0), (1, 2019, 4.0), (1, 2021, 9.0), (2, 2019, None), (2, 2020, 5.0)], "id int, year int, x double")
    got = {(r.id, r.year): r.dx for r in df.withColumn("dx", panel.difference("x", "id", "year")).collect()}
    assert got == {(1, 2018): None, (1, 2019): 3.0, (1, 2021): None, (2, 2019): None, (2, 2020): None}


def test_forward_fill_stops_at_resets(spark):
    df = spark.createDataFrame([(1, 1, 7, False), (1, 2, None, False), (1, 3, None, True), (1, 4, None, False), (1, 5, 8, False)], "id int, y int, firm int, reset boolean")
    got = {r.y: r.firm_filled for r in panel.filled_blocks(df, "id", "y", "firm", F.col("reset")).collect()}
    assert got == {1: 7, 2: 7, 3: None, 4: None, 5: 8}


def test_fallback_names_the_level(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "z"), (None, None)], "k string, g string")
    near, far = spark.createDataFrame([("a", 1.0)], "k string, v double"), spark.createDataFrame([("x", 2.0)], "g string, v double")
    got = {r.k: (r.v, r.match_level) for r in relational.fallback(rows, [("near", near, ["k"]), ("far", far, ["g"])], "v").collect()}
    assert got == {"a": (1.0, "near"), "b": (2.0, "far"), "c": (None, "none"), None: (None, "none")}


def test_checked_join_fails_on_repeated_keys(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        relational.left_checked(a, spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), ["k"])


def test_ledger(spark):
    ledger = spark.createDataFrame([("a", 2, "failed"), ("b", 1, "failed"), ("c", 1, "failed")], "uid string, attempts int, status string")
    one = lambda *u: spark.createDataFrame([(x,) for x in u], "uid string")
    got = {r.uid: (r.attempts, r.status) for r in relational.merge_ledger(ledger, one("a", "d"), one("b")).collect()}
    assert got == {"a": (3, "needs_manual"), "c": (1, "failed"), "d": (1, "failed")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='abc",\\ [', max_size=12), max_size=5))
def test_repair_keeps_valid_lists(xs):
    import json

    body = json.dumps(xs)
    assert json.loads(S.repaired(f"```json\n{body}\n```")) == xs
    cut = S.repaired(body[:-1])
    assert cut is None or json.loads(cut) == xs[: len(json.loads(cut))]


def test_items():
    assert S.items('["a", {"task": "b"}, ') == ["a", "b"]
    assert S.items('"[\\"x\\", \\"y\\"]"') == ["x", "y"]
    assert S.items("- first statement here\n2. second statement here\nshort") == ["first statement here", "second statement here"]
    assert S.items(None) == [] and S.items("N/A") == []


def test_keywords(spark):
    terms = ["ki", "ai", "neural networks", "e.g.", "modelle"]
    df = spark.createDataFrame([("KI und ai.",), ("maison kai",), ("neural-networks",), (None,), ("",), ("Sprachmodelle, e.g. neural networks",)], "t string")
    got = [(r.m, r.hit) for r in df.select(K.matched(F.col("t"), terms).alias("m"), K.any_of(F.col("t"), terms).alias("hit")).collect()]
    assert got == [("ai, ki", True), ("", False), ("", True), ("", False), ("", False), ("e.g., neural networks", True)]


@given(st.text("akimo e.g-_", max_size=30), st.lists(st.sampled_from(["ai", "ki", "e.g", "mo", "ai mo", "kimoak", "a"]), max_size=5))
@settings(max_examples=150, deadline=None)
def test_one_pass_equals_one_pattern_a_term(text, terms):
    k = K.Keywords(tuple(terms))
    edged = lambda t: re.search(T.word_pattern(t), text)
    assert k.words(text) == sorted({t for t in terms if edged(t)})
    kinds = T.pattern_classes(terms)
    assert k.any(text) == (any(edged(t) for t in kinds["dotted"] + kinds["short"]) or any(t in text for t in kinds["long"]) or any(re.search(T.flexible_phrase(t), text) for t in kinds["phrase"]))


def test_codes(spark):
    df = spark.createDataFrame([("['1','2']",), ('["1", "2"]',), ("{1,2}",), (" 1 2 ",), ("[]",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(T.codes(F.col("c"))).collect()] == [["1", "2"]] * 4 + [[]] * 3


def test_whole_tables_are_normalised(spark, tmp_path):
    from tasklattice.queries import exchange, texts

    docs = {1: "Größe  Łódź – Ünï\u00a0X!", 2: None, 3: "&lt;b&gt;Caf&eacute;&lt;/b&gt; <p>ﬁn &amp; Ｏk</p>", 4: "Привет, мир", 5: "\u2003Straße\tİ"}
    spark.createDataFrame([(k, t, None, "web") for k, t in docs.items()], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ads = [("a", "Œuvre № 1_ß", " ['x1' , \"y2\"] "), ("b", "Привет—мир", "[]"), ("c", None, None), ("d", "é", "null"), ("e", "e", "7")]
    spark.createDataFrame([(u, "t", "f", t, x) for u, t, x in ads], "uid string, title string, company_name string, content_clean string, x28_occupations string").write.parquet(f"{tmp_path}/job_postings_unified.parquet")
    got = lambda q, n: {r[0]: r[1] for r in q[n](spark, str(tmp_path)).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got(texts.QUERIES, "text_normalize_ascii") == {1: "groe odz unix!", 2: None, 3: "&lt;b&gt;caf&eacute;&lt;/b&gt; <p>n &amp; k</p>", 4: ",", 5: "strae i"}
    assert got(texts.QUERIES, "text_html_clean") == {1: "größe łódź – ünï x!", 2: "", 3: "café fin & ok", 4: "привет, мир", 5: "straße i̇"}
    assert got(texts.QUERIES, "hash_md5_content") == {k: md5(" ".join((t or "").lower().split())) for k, t in docs.items()}
    assert got(texts.QUERIES, "text_normalize_db") == {"a": md5("oeuvre no 1 ss"), "b": md5("привет мир"), "d": md5("e"), "e": md5("e")}
    assert got(exchange.QUERIES, "cast_text_array") == {"a": ["x1", "y2"], "b": None, "c": None, "d": None, "e": ["7"]}


def test_near_copies(spark):
    base = " ".join(f"wort{i}" for i in range(300))
    rows = [("a", 1, "t", base, "2020-01-01"), ("b", 1, "t", base + " ende", "2020-01-02"), ("c", 1, "t", "ganz anderer text hier", "2020-01-03"), ("d", 2, "t", base, "2020-01-01"), ("e", 1, "t", base, "2020-02-01")]
    df = spark.createDataFrame(rows, "uid string, company_id int, title string, content_clean string, tst_created string")
    assert {r.uid: r.kept_uid for r in dedup.near_copies(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "a"}


def test_near_copies_of_any_length(spark):
    base = " ".join(f"wort{i}" for i in range(300))
    rows = [("a", 1, "t", base, "2020-01-01"), ("b", 1, "t", f"{base} {base}", "2020-01-02"), ("c", 1, "t", "", "2020-01-03")]
    df = spark.createDataFrame(rows, "uid string, company_id int, title string, content_clean string, tst_created string")
    assert {r.uid: r.kept_uid for r in dedup.near_copies(df).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_near_copies_equal_one_matrix_over_the_group():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 12, size=rng.integers(3, 40))) for _ in range(60)] * 2
    rows, width = dedup.tfidf(texts)
    x = np.zeros((len(texts), width))
    for i, (at, weight) in enumerate(rows):
        x[i, at] = weight
    c, want = x @ x.T, []
    for i in range(len(texts)):
        want.append(next((j for j in range(i) if want[j] is None and c[i, j] >= 0.6), None))
    assert dedup.first_alike(texts, 0.6, 7) == want == dedup.first_alike(texts, 0.6, 400) and any(want)


def test_similarity_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(70, 8)).astype(np.float32), rng.normal(size=(90, 8)).astype(np.float32)
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None), (998, [0.0] * 8)], "vec_id bigint, vec array<float>")
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a.astype(float), b.astype(float)))
    c = ua @ ub.T
    assert {(r.a, r.b) for r in similarity.pairs_above(frame(a), frame(b), 0.5).collect()} == set(zip(*map(list, np.nonzero(c >= 0.5))))
    got = {(r.query, r["rank"]): r.item for r in similarity.best_for_each(frame(a), frame(b), 3).collect()}
    assert got == {(i, k + 1): int(j) for i in range(70) for k, j in enumerate(np.argsort(-c[i], kind="stable")[:3])}


def _vectors(spark, a, b, path):
    rows = [(k + 1, kind, v) for k, (kind, v) in enumerate([("app", v.tolist()) for v in a] + [("task", v.tolist()) for v in b] + [("app", None), ("task", [0.0] * a.shape[1])])]
    spark.createDataFrame(rows, "vec_id bigint, kind string, vec array<float>").write.parquet(f"{path}/text_vectors.parquet")


def test_best_hundredth_of_all_pairs_without_writing_them(spark, tmp_path):
    """Vectors stand five times, so that cosines are tied where the percentile lies."""
    from pathlib import Path

    from tasklattice.plans.lineage import shared_dir
    from tasklattice.queries import more

    rng = np.random.default_rng(8)
    a, b = (np.repeat(rng.normal(size=(n, 12)).astype(np.float32), 5, axis=0) for n in (140, 90))
    _vectors(spark, a, b, tmp_path)
    c = similarity.exact_cosines(a, np.repeat(np.arange(len(a)), len(b)), b, np.tile(np.arange(len(b)), len(a)))
    assert np.allclose(c, ((a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T).ravel(), atol=1e-5)
    place = Path(shared_dir(spark).removeprefix("file:"))
    old = set(place.iterdir())
    got = more.QUERIES["join_sim_exhaustive"](spark, str(tmp_path)).collect()
    assert [r.n for r in got] == [int((c >= np.quantile(c, 0.99)).sum())]
    assert sum(spark.read.parquet(str(p)).count() for p in set(place.iterdir()) - old) < len(c) / 100
    v = spark.read.parquet(f"{tmp_path}/text_vectors.parquet")
    for share in (0.0, 0.3, 1.0):  # in parts, and narrowed down by histograms
        parts = similarity.reaching_percentile(v.filter("kind = 'app'"), v.filter("kind = 'task'"), share, sent=9000, most=2)
        assert parts.first().n == int((c >= np.quantile(c, share)).sum())
    assert similarity.reaching_percentile(v.filter("kind = 'none'"), v, 0.99).first().n == 0


def _greedy(keys, x, threshold):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    heads, own = [], {}
    for i in np.argsort(keys):
        own[keys[i]] = next((keys[j] for j in heads if u[i] @ u[j] >= threshold), keys[i])
        heads += [i] if own[keys[i]] == keys[i] else []
    return own


def test_greedy_clusters_in_blocks_equal_one_pass(spark):
    from tasklattice.operators import studies

    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(40, 6)), 8, axis=0) + rng.normal(size=(320, 6)) * 0.25
    x = np.vstack((x, np.zeros((3, 6)), x[:9])).astype(np.float32)
    keys = [int(k) for k in rng.permutation(len(x)) + 2**60]
    kinds = [(None, "a", "b")[k % 3] if k % 7 else "a" for k in range(len(x))]
    df = spark.createDataFrame([(k, g, v.tolist()) for k, g, v in zip(keys, kinds, x)] + [(1, "a", None)], "id bigint, g string, v array<float>")
    want = {}
    for g in (None, "a", "b"):
        own = [i for i, h in enumerate(kinds) if h == g]
        want |= _greedy([keys[i] for i in own], x[own].astype(float), 0.9)
    assert 50 < len(set(want.values())) < 250
    for numbers in (1 << 21, 6 * 30):  # in one block, and in many
        got = studies.greedy_clusters(df.repartition(5), "g", "id", "v", 0.9, numbers)
        assert got.columns == ["id", "representative"]
        assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert studies.greedy_clusters(df.limit(0), "g", "id", "v", 0.9).count() == 0


def test_first_fit_meets_representatives_only():
    """Thirty thousand vectors around eight took minutes one by one."""
    from time import process_time

    from tasklattice.operators import studies

    rng = np.random.default_rng(10)
    x = rng.normal(size=(30_000, 48)).astype(np.float32)
    x[::3] = x[:8][rng.integers(0, 8, 10_000)] + 1e-3 * x[::3]
    began = process_time()
    own = studies.first_fit(x, 0.99, np.empty(0, np.int64), 700)
    assert process_time() - began < 60
    assert (own[own] == own).all() and (own <= np.arange(len(x))).all() and len(np.unique(own)) < 20_050
    for i in rng.integers(0, len(x), 30):
        c = similarity.exact_cosines(x, np.full(i, i), x, np.arange(i)) if i else np.empty(0)
        hit = np.flatnonzero((c >= 0.99) & (own[:i] == np.arange(i)))
        assert own[i] == (hit[0] if len(hit) else i)


def test_ols_and_logit(spark):
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=400), rng.integers(0, 20, 400)
    y = 2 + 3 * x + rng.normal(size=400)
    z = (rng.uniform(size=400) < 1 / (1 + np.exp(-x))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for a, b, c, d in zip(x, y, z, g)] + [(None, 1.0, 1.0, 1), (float("nan"), 1.0, 1.0, 1)], "x double, y double, z double, g int")
    fit = estimators.ols(df, "y", ["x"], clusters=["g"])
    m = np.column_stack((np.ones(400), x))
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    e = y - m @ beta
    s = np.stack([(m * e[:, None])[g == k].sum(axis=0) for k in range(20) if (g == k).any()])
    inv = np.linalg.inv(m.T @ m)
    v = inv @ s.T @ s @ inv * len(s) / (len(s) - 1) * 399 / 398
    assert fit.n == 400 and np.allclose(fit.coef, beta) and np.allclose(fit.se, np.sqrt(np.diag(v)))
    lg = estimators.logit(df, "z", ["x"])
    mu = 1 / (1 + np.exp(-(m @ lg.coef)))
    assert np.abs(m.T @ (z - mu)).max() < 1e-6


def test_sampling_takes_whole_entities(spark):
    df = spark.createDataFrame([(k, i) for k in range(40) for i in range(1 + k % 12)], "k int, i int")
    got = sampling.whole_entities(df, "k", 50, "s").collect()
    assert sum(r.n_rows for r in got) >= 50 and all(r.n_rows == 1 + r.k % 12 for r in got)
    assert {r.k for r in got} == {r.k for r in sampling.whole_entities(df.repartition(3), "k", 50, "s").collect()}


def test_groups_are_joined_back_however_many_are_hot(spark):
    from tasklattice.plans.skew import join_groups_back

    rows = spark.createDataFrame([(i % 7, i) for i in range(70)] + [(99, 1)], "k int, v int")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    for most in (2, 100):
        assert join_groups_back(rows, groups, ["k"], "n", heavy=5, most=most).count() == 71


def test_model_runs_differ_and_vote(spark):
    from tasklattice.functions import models

    df = spark.createDataFrame([(1, "Ein Modell a. Ein Modell b. Kein Wort."), (2, None)], "uid int, t string")
    got = {(r.uid, r.item): r.votes for r in models.ensemble(df, "t", models.SeededModel, least=1).collect()}
    want = {s: sum(s in __import__("json").loads(models.SeededModel(k)(["Ein Modell a. Ein Modell b."])[0]) for k in range(5)) for s in ("Ein Modell a.", "Ein Modell b.")}
    assert got == {(1, s): n for s, n in want.items() if n} and len({models.SeededModel(k)(["Ein Modell a. Ein Modell b."])[0] for k in range(5)}) > 1
