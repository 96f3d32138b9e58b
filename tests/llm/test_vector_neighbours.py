import numpy as np

from tasklattice.llm.vector_neighbours import code_products, linked, nearest, quantise


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -9)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(c[r, j], 9), ids[j]))[:k]] for r, i in enumerate(ids)}


def test_bound():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, scale, rest = quantise(x)
    y = code * scale[:, None]
    assert (np.abs(y @ y.T - x @ x.T) <= rest[:, None] + rest + np.outer(rest, rest) + 1e-12).all()


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.float32(base[rng.integers(0, 40, 900)] + rng.normal(scale=0.3, size=(900, 16)) * rng.uniform(0.1, 3, (900, 1)))
    x[7] = x[3] * 2
    ids = [int(i) * 7 % 9973 for i in range(900)]
    df = spark.createDataFrame([(i, v.tolist(), "t") for i, v in zip(ids, x)] + [(100001, None, ""), (100002, [0.0] * 16, ""), (None, [1.0] * 16, ""), (100003, [float("nan")] * 16, ""), (ids[0], x[0].tolist(), "again")], "vec_id bigint, vec array<float>, b string")
    for group in (100 * 16, 65_536 * 64):
        got = {}
        for r in nearest(df, 5, group=group).collect():
            got.setdefault(r.a, []).append((-round(r.cosine, 9), r.b))
        assert {a: [b for _, b in sorted(v)] for a, v in got.items()} == brute(ids, x.astype(float), 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 2.0, 3.0])], "vec_id bigint, vec array<float>")
    assert {tuple(r) for r in linked(df).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert linked(df.limit(0)).count() == 0


def test_tiles_are_products_of_whole_numbers():
    rng = np.random.default_rng(3)
    for dim in (64, 1040, 1041, 4096):
        a, b = rng.integers(-127, 128, (2, 30, dim), dtype=np.int8)
        a[0] = b[0] = 127  # the largest sum there can be
        assert (code_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_long_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.float32(rng.normal(size=(60, 1500)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, vec array<float>")
    got = {}
    for r in nearest(df, 3, group=20 * 1500).collect():
        got.setdefault(r.a, []).append((-round(r.cosine, 9), r.b))
    assert {a: [b for _, b in sorted(v)] for a, v in got.items()} == brute(list(range(60)), x.astype(float), 3)
