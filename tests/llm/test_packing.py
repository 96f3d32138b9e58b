import random

import numpy as np

from tasklattice.llm import packing, tokens


def test_fill_respects_capacity_and_prefers_neighbours():
    rng = random.Random(1)
    sizes = [rng.randint(1, 30) for _ in range(300)] + [0, 100]
    boxes = packing.fill(sizes, 100, lambda i: np.array([float(j % 3 == i % 3) for j in range(len(sizes))]))
    assert sorted(i for b in boxes for i in b) == [i for i, s in enumerate(sizes) if s]
    assert all(sum(sizes[i] for i in b) <= 100 for b in boxes)
    assert len(boxes) <= 1.03 * sum(sizes) / 100 + 1


def test_bm25_by_definition():
    docs = [[1, 2, 2, 3], [2, 4], [5], [1, 3, 3, 3, 6]]
    s = packing.Index(docs).scores(0)
    avg = sum(map(len, docs)) / 4
    want = []
    for d in docs:
        w = 0
        for t in set(docs[0]):
            df = sum(t in x for x in docs)
            tf = d.count(t)
            w += np.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        want.append(w)
    assert np.allclose(s, want) and s[2] == 0


def test_packed(spark):
    texts = ["ein kurzer Text über Arbeit"] * 20 + ["a long text about vectors " * 60, None, "", "x"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "again")], "doc_id bigint, text string, piece string")
    sizes = {"small": 64, "large": 200}
    all_rows = packing.packed(df, sizes).collect()
    rows = [r for r in all_rows if r.container_kind == "small"]
    assert sum(r.n_tokens for r in rows) == sum(r.n_tokens for r in all_rows if r.container_kind == "large")
    size = {i: len(tokens.encode([t])[0]) for i, t in enumerate(texts)}
    got, boxes = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
    assert {i: sum(n for _, n in v) for i, v in got.items()} == {i: n for i, n in size.items() if n}
    assert all(len(v) == 1 for i, v in got.items() if size[i] <= 64) and max(boxes.values()) <= 64
    shares = {r.container_kind: r.used_share for r in packing.use(packing.packed(df, sizes), sizes).collect()}
    assert shares["small"] > 0.9 and set(shares) == {"small", "large"}
    assert packing.packed(df.limit(0), sizes).count() == 0 and packing.packed(df, {}).count() == 0


def test_all_tokens_of_a_long_seed_are_looked_up():
    """The one token shared with the seed is the lightest of a thousand."""
    docs = [list(range(1000)) + list(range(1, 1000)), [0], [5000]]
    assert packing.Index(docs).scores(0)[1] > 0


def test_both_files_of_one_tokenizer_agree():
    texts = ["Wir suchen 12 Leute – ab sofort!", "", None, "don't  \n\n stop <|endoftext|>", "日本語 ñ"]
    assert tokens.encode(texts) == tokens.encode(texts, f"{tokens.FOLDER}/byte_bpe_50k.json")
