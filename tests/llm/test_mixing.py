import numpy as np

from tasklattice.llm import mixing


def test_rake_meets_sources_and_caps():
    rng = np.random.default_rng(1)
    have = rng.integers(0, 1000, (3, 4, 8)).astype(float)
    have[2] /= 50
    target, cap = np.array([0.5, 0.3, 0.2]), np.array([1.0, 2, 4])
    total = float((have.sum(axis=(1, 2)) * cap / target).min())
    w = mixing.rake(have, target, cap, total)
    assert np.allclose(w.sum(axis=(1, 2)), target * total, rtol=1e-6)
    assert (w <= have * cap[:, None, None] + 1e-6).all() and w.min() >= 0


def test_mixture(spark):
    word = ["Planung", "Kontrolle", "Lager", "vectors", "tasks", "report"]
    docs = [(i, f"Wir suchen {word[i % 6]} und mehr. " * (1 + i % 7), ["a", "b", "b", "c", "other", None][i % 6], i) for i in range(600)] + [(9001, None, "a", 0), (9002, "", "b", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixed, total = mixing.mixture(df, targets)
    rows = mixed.collect()
    assert {r.source for r in rows} == {"a", "b", "c"} and len({r.doc_id for r in rows}) == len(rows)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(got[s].actual_share - t / 0.9) < 0.02 and got[s].most_copies <= got[s].max_repeats
    assert got["absent"].actual_share == 0 and abs(sum(r.n_tokens * r.copies for r in rows) / total - 1) < 0.02


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, _ = mixing.mixture(df, targets)
    assert mixed.count() == 0 and mixing.shares(mixed, targets).first().actual_share == 0


def test_topics_are_fitted_on_all_documents(spark):
    """Few documents are where topics begin, but every centre is the mean of all
    documents that are nearest to it."""
    kinds = ["Planung Kontrolle Termine", "vectors tasks report", "Lager Waren Kisten"]
    rows = [(i, *(x.tobytes() for x in mixing.features(kinds[i % 3] + f" wort{'abcdefgh'[i % 8]}xyz"))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, slots binary, weights binary")
    centres = mixing.topics(df, k=3, start=30)
    own = (mixing.dense([r[1] for r in rows], [r[2] for r in rows]) @ centres.T).argmax(axis=1)
    assert len({int(x) for x in own}) >= 2
    x = mixing.dense([r[1] for r in rows], [r[2] for r in rows])
    for i in set(own):  # each centre is the mean direction of all its documents
        mean = x[own == i].sum(axis=0)
        assert np.allclose(mean / np.linalg.norm(mean), centres[i], atol=5e-3)
