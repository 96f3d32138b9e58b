"""Adapters for external models, with stand-ins that always answer the same.

A model is any picklable object with ``__call__`` from a list of inputs to a list
of outputs; it is called once per Arrow batch, so a real one can batch on a device
or over a connection it opens on first use.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HashedEmbedder:
    """Unit vectors of hashed words."""

    def __init__(self, dims: int):
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in re.findall(r"\w+", (t or "").lower()):
                v[crc32(w.encode()) % self.dims] += 1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


class OverlapScorer:
    """Share of the words of both texts that they share."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        bags = [(set((a or "").lower().split()), set((b or "").lower().split())) for a, b in pairs]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in bags]


class EchoModel:
    """The sentences that speak of models, as a JSON list."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [json.dumps([s.strip() for s in re.split(r"(?<=[.!?])\s+", p or "") if re.search(r"model|modèl|modell", s, re.I)], ensure_ascii=False) for p in prompts]


class SeededModel:
    """As :class:`EchoModel`, but each seed overlooks one sentence in four."""

    def __init__(self, seed: int):
        self.seed = seed

    def __call__(self, prompts: list[str]) -> list[str]:
        seen = lambda s: crc32(f"{self.seed}|{s}".encode()) % 4 > 0
        return [json.dumps([s for s in json.loads(a) if seen(s)], ensure_ascii=False) for a in EchoModel()(prompts)]


def ensemble(rows: DataFrame, column: str, model, runs: int = 5, least: int = 3, key: str = "uid") -> DataFrame:
    """(key, item, votes): the statements that at least ``least`` of ``runs``
    answers hold. ``model`` makes a model from a seed; each run asks its own."""
    from tasklattice.functions.structured import exploded

    answers = None
    for seed in range(runs):
        one = exploded(completed(rows, column, model(seed), key).select(key, "response"), key, "response").select(key, "item").distinct()
        answers = one if answers is None else answers.unionByName(one)
    return answers.groupBy(key, "item").agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)


def semantic_majority(rows: DataFrame, column: str, model, embedder, runs: int = 5, least: int = 3, alike: float = 0.75, key: str = "uid") -> DataFrame:
    """(key, item, members): statements of all runs are grouped, each with those
    whose cosine reaches ``alike`` and that begin no group before it; a later group
    may take a member again. Groups of at least ``least`` give their most frequent
    statement, of equally frequent ones the first. One ad's statements are one
    group of rows, which the runs bound."""
    from tasklattice.functions.structured import exploded

    answers = None
    for seed in range(runs):
        one = exploded(completed(rows, column, model(seed), key).select(key, "response"), key, "response").withColumn("run", F.lit(seed))
        answers = one if answers is None else answers.unionByName(one)
    kind = rows.schema[key].dataType.simpleString()

    def vote(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        said = pdf.sort_values(["run", "position"])["item"].tolist()
        v = np.asarray(embedder(said))
        near = v @ v.T >= alike - 1e-12
        seen, out = set(), []
        for i in range(len(said)):
            if i not in seen and (group := np.flatnonzero(near[i])).size:
                seen |= set(group.tolist())
                if len(group) >= least:
                    out.append((k[0], Counter(said[j] for j in group).most_common(1)[0][0], len(group)))
        return pd.DataFrame(out, columns=[key, "item", "members"])

    return answers.groupBy(key).applyInPandas(vote, f"{key} {kind}, item string, members int")


def embedded(rows: DataFrame, column: str, model) -> DataFrame:
    schema = rows.schema.simpleString()[7:-1].replace(":", " ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=model(b[column].tolist()))

    return rows.mapInPandas(run, f"{schema}, embedding array<double>".replace(",", ", "))


def scored(rows: DataFrame, a: str, b: str, model, least: float = 0.0) -> DataFrame:
    """(a, b, score) of at least ``least``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x[[a, b]].assign(score=model(list(zip(x[a], x[b], strict=True))))

    return rows.select(a, b).mapInPandas(run, f"{a} string, {b} string, score double").filter(F.col("score") >= least)


def completed(rows: DataFrame, column: str, model, key: str = "uid") -> DataFrame:
    """(key, response, cache_key): each different prompt is answered once."""
    keyed = rows.select(key, column).withColumn("cache_key", F.sha2(F.coalesce(column, F.lit("")), 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x[["cache_key"]].assign(response=model(x["prompt"].tolist()))

    answers = keyed.groupBy("cache_key").agg(F.first(column).alias("prompt")).mapInPandas(run, "cache_key string, response string")
    return keyed.select(key, "cache_key").join(answers, "cache_key").select(key, "response", "cache_key")
