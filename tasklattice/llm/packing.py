"""Containers of fixed capacity, filled by lexical retrieval.

Documents are dealt to shards. Each shard builds an inverted index with BM25
weights over its documents' tokens. The largest document without a container
seeds a new one; the index returns its unused neighbours, best first, which
greedily fill the window; what space is left takes the largest unused documents
that still fit. A document longer than the capacity gives full containers of its
own, and its end is an item like the others.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.llm import tokens

#: About so many documents, and at most about so many characters, share an index.
SHARD_DOCS, SHARD_CHARS = 2000, 32_000_000
_K1, _B = 1.2, 0.75


class Index:
    """BM25 over the token ids of a shard's documents."""

    def __init__(self, docs: list[list[int]]):
        self.n = len(docs)
        uniq = [np.unique(np.asarray(d, dtype=np.int64), return_counts=True) for d in docs]
        term = np.concatenate([u for u, _ in uniq]) if docs else np.empty(0, np.int64)
        tf = np.concatenate([c for _, c in uniq]) if docs else np.empty(0)
        doc = np.repeat(np.arange(self.n), [len(u) for u, _ in uniq])
        length = np.array([len(d) for d in docs], dtype=float)
        self.terms, inv, df = np.unique(term, return_inverse=True, return_counts=True)
        self.idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        norm = _K1 * (1 - _B + _B * length / max(1.0, length.mean() if self.n else 1.0))
        weight = self.idf[inv] * tf * (_K1 + 1) / (tf + norm[doc])
        order = np.argsort(inv, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.concatenate(([0], np.cumsum(df)))
        ends = np.cumsum([len(u) for u, _ in uniq])
        self.own = [inv[e - len(u) : e] for e, (u, _) in zip(ends, uniq, strict=True)]

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document for document ``i``, all its tokens, as the query."""
        t = self.own[i]
        first, n = self.start[t], self.start[t + 1] - self.start[t]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(t) else 0) + np.repeat(first - ends + n, n)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill(sizes: list[int], capacity: int, scores) -> list[list[int]]:
    """Items (sizes up to ``capacity``, 0 is left out) in containers. ``scores``
    gives for an item the weight of all others as its neighbours."""
    size = np.asarray(sizes)
    unused = size > 0
    by_size = sorted((int(s), i) for i, s in enumerate(size) if s > 0)
    smallest = by_size[0][0] if by_size else 0
    out = []
    while by_size:
        _, seed = by_size.pop()
        unused[seed] = False
        box, left = [seed], capacity - int(size[seed])
        if by_size and left >= smallest:
            s = scores(seed)
            near = np.flatnonzero(unused & (s > 0) & (size <= left))
            for i in near[np.lexsort((near, -s[near]))]:
                if size[i] <= left:
                    box.append(int(i))
                    left -= int(size[i])
                    unused[i] = False
                    k = bisect_right(by_size, (int(size[i]), int(i))) - 1
                    del by_size[k]
                    if left < smallest:
                        break
            while by_size and (k := bisect_right(by_size, (left, len(size)))):
                s_, i = by_size.pop(k - 1)
                box.append(i)
                left -= s_
                unused[i] = False
            smallest = by_size[0][0] if by_size else 0
        out.append(box)
    return out


def packed(docs: DataFrame, capacities: dict[str, int], path: str = f"{tokens.FOLDER}/{tokens.TOKENIZER}", key: str = "doc_id", column: str = "text") -> DataFrame:
    """(container_kind, container_id, doc_id, piece, first_token, n_tokens): for
    each kind of container of ``capacities`` in which container each document, or
    each piece of a longer one, lies. Pieces count from 0. Null and empty texts
    have no tokens and no container; repeated rows of a key are packed once (the
    text that sorts first). An empty input or no capacities give no rows.

    Shards are dealt by a hash of the key, so their sizes are even whatever the
    texts are; their number is taken from the rows as they are, which costs a scan
    and no shuffle. A text is shuffled for its key, where copies collapse on the
    map side, and to its shard, and split into tokens once for all kinds.
    """
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(column).alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    n, chars = own.agg(F.count("*"), F.sum(F.length("text"))).first()
    shards = max(1, math.ceil(n / SHARD_DOCS), math.ceil((chars or 0) / SHARD_CHARS))
    kinds = sorted((k, c) for k, c in capacities.items() if c and c > 0)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        ids = tokens.encode(pdf["text"].tolist(), path)
        shard, rows = int(pdf["shard"].iloc[0]), []
        for kind, capacity in kinds:
            ends, box_no = [], 0
            for d, x in zip(pdf["doc_id"], ids, strict=True):
                whole = len(x) // capacity if len(x) > capacity else 0
                for p in range(whole):
                    rows.append((kind, f"{shard}-{box_no}", d, p, p * capacity, capacity))
                    box_no += 1
                ends.append((d, whole, whole * capacity, len(x) - whole * capacity, x[whole * capacity :]))
            index = Index([e[4] for e in ends])
            for box in fill([e[3] for e in ends], capacity, index.scores):
                rows += [(kind, f"{shard}-{box_no}", *ends[i][:4]) for i in box]
                box_no += 1
        return pd.DataFrame(rows, columns=["container_kind", "container_id", "doc_id", "piece", "first_token", "n_tokens"])

    once = own.groupBy("doc_id").agg(F.min("text").alias("text"))
    sharded = once.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(pack, "container_kind string, container_id string, doc_id bigint, piece int, first_token int, n_tokens int")


def use(containers: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """One row for each kind: containers, tokens, and the share of the space used."""
    got = containers.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    capacity = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv]) if capacities else F.create_map().cast("map<string,int>")
    return got.withColumn("used_share", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * F.try_element_at(capacity, F.col("container_kind"))))
