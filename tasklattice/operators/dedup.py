"""Near duplicates within small groups, and one-to-one matching."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\b\w\w+\b")
#: Words too frequent in English to tell texts apart.
STOP = frozenset("the and of to in is it for on with as at by an be this that from or are was we you our your".split())


def tfidf(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Terms and weights of each text, of length one, and the number of terms:
    words and pairs of words, smooth inverse document frequency over the group,
    the most frequent min(5000, 100 n) terms."""
    bags = []
    for t in texts:
        ws = [w for w in _TOKEN.findall(t.lower()) if w not in STOP]
        bags.append(Counter(ws) + Counter(f"{a} {b}" for a, b in zip(ws, ws[1:])))
    total, df = Counter(), Counter()
    for b in bags:
        total.update(b)
        df.update(b.keys())
    terms = {t: i for i, (t, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[: min(5000, 100 * len(texts))])}
    out = []
    for b in bags:
        own = [(terms[t], n * (math.log((1 + len(texts)) / (1 + df[t])) + 1)) for t, n in b.items() if t in terms]
        at, weight = np.array([i for i, _ in own], dtype=np.int64), np.array([w for _, w in own], dtype=float)
        out.append((at, weight / max(float(np.linalg.norm(weight)), 1e-12)))
    return out, max(1, len(terms))


def first_alike(texts: list[str], threshold: float, block: int) -> list[int | None]:
    """For each text the first earlier one that is kept and whose cosine reaches
    ``threshold``; None for those that are kept. Only two blocks of texts are dense
    at a time."""
    rows, width = tfidf(texts)

    def dense(which: list[int]) -> np.ndarray:
        x = np.zeros((len(which), width))
        for k, i in enumerate(which):
            x[k, rows[i][0]] = rows[i][1]
        return x

    kept: list[int] = []
    hits: list[int | None] = [None] * len(texts)
    for s in range(0, len(texts), block):
        new = list(range(s, min(len(texts), s + block)))
        x = dense(new)
        for k in range(0, len(kept), block):
            near = x @ dense(kept[k : k + block]).T >= threshold
            for i in np.flatnonzero(near.any(axis=1)):
                if hits[s + i] is None:
                    hits[s + i] = kept[k + int(near[i].argmax())]
        near = x @ x.T >= threshold
        for i in range(len(new)):
            if hits[s + i] is None:
                hits[s + i] = next((s + int(j) for j in np.flatnonzero(near[i, :i]) if hits[s + j] is None), None)
        kept += [i for i in new if hits[i] is None]
    return hits


def near_copies(rows: DataFrame, threshold: float = 0.99, block: int = 400) -> DataFrame:
    """``rows`` has uid, company_id, title, content_clean, tst_created: (uid,
    kept_uid), where kept_uid is the uid itself or that of the first earlier ad of
    the same firm and title that is kept and whose TF-IDF cosine reaches
    ``threshold``.

    Exact copies are set aside first, by a join on their digest. Terms and weights
    are those of all texts of one firm and title, whatever their length, and all
    these texts are compared, ``block`` by ``block``.
    """
    digest = F.md5(F.col("content_clean").cast("binary"))
    own = rows.withColumn("h", digest)
    first = own.groupBy("company_id", "title", "h").agg(F.min_by("uid", F.struct("tst_created", "uid")).alias("first_uid"), F.min("tst_created").alias("t"), F.first("content_clean").alias("text"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "first_uid"], na_position="last")
        uids = pdf["first_uid"].tolist()
        hits = first_alike(pdf["text"].tolist(), threshold, block)
        return pd.DataFrame([(u, uids[i]) for u, i in zip(uids, hits, strict=True) if i is not None], columns=["first_uid", "kept_uid"])

    # Most firms use a title once: only groups of two texts or more go to Python.
    groups = first.groupBy("company_id", "title").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    several = first.select("company_id", "title", "first_uid", "t", "text").join(groups, ["company_id", "title"], "left_semi")
    near = several.groupBy("company_id", "title").applyInPandas(greedy, "first_uid string, kept_uid string")
    heads = first.select("company_id", "title", "h", "first_uid").join(near, "first_uid", "left").withColumn("kept_uid", F.coalesce("kept_uid", "first_uid"))
    return own.select("uid", "company_id", "title", "h").join(heads, ["company_id", "title", "h"]).select("uid", "kept_uid")


def _bag(text: str) -> Counter:
    return Counter(_TOKEN.findall(text.lower()))


def greedy_pairs(a: DataFrame, b: DataFrame, key: str, threshold: float = 0.3) -> DataFrame:
    """One-to-one pairs of items of one key, the most alike words first:
    (key, a, b, score)."""
    kind = a.schema[key].dataType.simpleString()

    def match(k: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        for i, s in enumerate(x["item"]):
            for j, t in enumerate(y["item"]):
                p, q = _bag(s), _bag(t)
                both = sum((p & q).values())
                if both and (score := both / math.sqrt(sum(p.values()) * sum(q.values()))) >= threshold:
                    pairs.append((score, i, j))
        used_a, used_b, out = set(), set(), []
        for score, i, j in sorted(pairs, key=lambda z: (-z[0], z[1], z[2])):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((k[0], x["item"].iloc[i], y["item"].iloc[j], score))
        return pd.DataFrame(out, columns=[key, "a", "b", "score"])

    return a.groupBy(key).cogroup(b.groupBy(key)).applyInPandas(match, f"{key} {kind}, a string, b string, score double")
