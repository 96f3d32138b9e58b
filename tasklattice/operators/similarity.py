"""Cosine joins of two collections, in blocks multiplied as matrices.

The smaller side is dealt to a few groups and each group meets every row of the
larger side once, so no pair is missed and no task holds more than one group and
one batch. Vectors that are null, all zero or hold nulls take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.plans.lineage import cut

#: Vectors of the right side that one row carries.
BLOCK = 4096
#: Numbers that a packed row of either side carries (8,192 vectors of 64), and
#: bytes of one side that are broadcast at a time.
PACK, SENT = 8192 * 64, 64 << 20
#: Bins of a histogram of cosines, and cosines of a tile.
BINS, TILE = 65_536, 1 << 19


def _clean(rows: DataFrame, key: str, vec: str) -> DataFrame:
    v = F.col(vec)
    return rows.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).filter(F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows packed into blocks of up to BLOCK unit vectors."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), BLOCK):
                part = b.iloc[i : i + BLOCK]
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame([{"ids": part["id"].to_numpy(np.int64).tobytes(), "x": x.tobytes()}])

    return rows.mapInPandas(pack, "ids binary, x binary")


def _joined(left: DataFrame, right: DataFrame, key: str, vec: str, keep) -> DataFrame:
    """All pairs of blocks; ``keep`` picks from each matrix of cosines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for li, lx, ri, rx in zip(b["ids"], b["x"], b["rids"], b["rx"], strict=True):
                a, c = np.frombuffer(li, np.int64), np.frombuffer(ri, np.int64)
                m = np.frombuffer(lx).reshape(len(a), -1) @ np.frombuffer(rx).reshape(len(c), -1).T
                i, j = keep(m)
                yield pd.DataFrame({"a": a[i], "b": c[j], "cosine": m[i, j]})

    lb = _blocks(_clean(left, key, vec))
    rb = _blocks(_clean(right, key, vec)).select(F.col("ids").alias("rids"), F.col("x").alias("rx"))
    # Pairs of blocks, not of rows: (n / BLOCK) * (m / BLOCK) of them.
    pairs = lb.crossJoin(rb).repartition(4 * left.sparkSession.sparkContext.defaultParallelism)
    return pairs.mapInPandas(run, "a bigint, b bigint, cosine double")


def pairs_above(left: DataFrame, right: DataFrame, threshold: float, key: str = "vec_id", vec: str = "vec") -> DataFrame:
    """(a, b) with a cosine of at least ``threshold``."""
    return _joined(left, right, key, vec, lambda m: np.nonzero(m >= threshold)).select("a", "b")


def best_for_each(queries: DataFrame, items: DataFrame, k: int, key: str = "vec_id", vec: str = "vec") -> DataFrame:
    """(query, item, cosine, rank): the ``k`` items of the highest cosine for each
    query; ties go to the smaller id."""

    def top(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if m.shape[1] <= k:
            return np.nonzero(np.ones_like(m, dtype=bool))
        bar = -np.partition(-m, k - 1, axis=1)[:, k - 1]
        return np.nonzero(m >= bar[:, None])

    got = _joined(queries, items, key, vec, top).select(F.col("a").alias("query"), F.col("b").alias("item"), "cosine")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "item")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rounding(dim: int) -> float:
    """Bound of what a product of unit vectors in single floats is off by."""
    return (dim + 8) * 2.0**-24


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one in single floats; rows of zeros stay."""
    x = x.astype(np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def exact_cosines(a: np.ndarray, i: np.ndarray, c: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows ``i`` of ``a`` with rows ``j`` of ``c``, added up one number
    after the other in double floats: the same for equal vectors wherever they
    stand, and the same as in SQL."""
    out = np.empty(len(i))
    for s in range(0, len(i), 16_384):
        x, y = (np.ascontiguousarray(v[k[s : s + 16_384]].T, dtype=np.float64) for v, k in ((a, i), (c, j)))
        dot, xx, yy = np.zeros((3, x.shape[1]))
        for p, q in zip(x, y, strict=True):
            dot += p * q
            xx += p * p
            yy += q * q
        out[s : s + 16_384] = np.clip(dot / np.sqrt(xx * yy), -1, 1)
    return out


def _pack(rows: DataFrame, dim: int, kind: type, name: str) -> DataFrame:
    """Rows packed into even blocks of at most PACK numbers, as they are."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in np.array_split(b["v"].to_numpy(), math.ceil(len(b) / max(1, PACK // dim))) if len(b) else ():
                x = np.stack(part).astype(kind)
                if x.shape[1] != dim:
                    raise ValueError(f"vectors of {x.shape[1]} and {dim} numbers")
                yield pd.DataFrame([{name: x.tobytes()}])

    return rows.select("v").mapInPandas(pack, f"{name} binary")


def _value_at(values: DataFrame, place: int, most: int = 100_000) -> float:
    """The value that stands at ``place``, from 0 at the top, of a table of
    different values and their numbers ``n``. Histograms narrow the table down
    until no more than ``most`` values are left."""
    v = F.col("cosine")
    while values.count() > most:
        low, high = values.agg(F.min(v), F.max(v)).first()
        bin_ = F.least(F.floor((v - low) / ((high - low) / 1024)), F.lit(1023))
        for at, n in sorted(map(tuple, values.groupBy(bin_.alias("bin")).agg(F.sum("n")).collect()), reverse=True):
            if place < n:
                break
            place -= n
        values = values.filter(bin_ == at)
    for value, n in sorted(map(tuple, values.select(v, "n").collect()), reverse=True):
        if place < n:
            return value
        place -= n
    raise ValueError("fewer values than that")


def reaching_percentile(left: DataFrame, right: DataFrame, share: float, key: str = "vec_id", vec: str = "vec", sent: int = SENT, most: int = 100_000) -> DataFrame:
    """(n): how many of all pairs have a cosine of at least the percentile at
    ``share`` of all pairs, which lies between two of them as ``quantile_cont`` has
    it. Exact, and no pair is written down but those next to the percentile.

    A first pass counts the cosines of all pairs, in single floats, in narrow bins.
    A second one counts the pairs that rounding can't bring down to the bins of the
    percentile, and computes those that lie in them or near again, in double
    floats. The smaller side is broadcast, at most ``sent`` bytes at a time, and the
    other side meets all of it. Vectors must be of one length.
    """
    kind = np.float64 if "double" in left.schema[vec].dataType.simpleString() + right.schema[vec].dataType.simpleString() else np.float32
    finite = lambda rows: _clean(rows, key, vec).filter(~F.exists("v", lambda x: F.abs(x) == float("inf")))
    sides = [finite(left), finite(right)]
    sizes = [x.agg(F.count("*"), F.max(F.size("v"))).first() for x in sides]
    total = sizes[0][0] * sizes[1][0]
    if not total:
        return left.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n"))
    order = sorted((0, 1), key=lambda k: sizes[k][0])
    small, large = (sides[k] for k in order)
    n, dim = sizes[order[0]]
    parts = math.ceil(n * dim * np.dtype(kind).itemsize / sent)
    large = _pack(large.repartition(4 * left.sparkSession.sparkContext.defaultParallelism), dim, kind, "x")

    def passes(run: Callable, schema: str) -> list[DataFrame]:
        own = [small.filter(F.pmod(F.xxhash64("v"), F.lit(parts)) == p) for p in range(parts)] if parts > 1 else [small]
        return [large.crossJoin(F.broadcast(_pack(x, dim, kind, "y"))).mapInPandas(run, schema) for x in own]

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            for x, y in zip(b["x"], b["y"], strict=True):
                a, c = (np.frombuffer(z, kind).reshape(-1, dim) for z in (x, y))
                ua, uc = units(a), units(c).T
                step = max(1, TILE // len(c))
                for s in range(0, len(a), step):
                    yield a[s : s + step], c, ua[s : s + step] @ uc

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BINS + 2, dtype=np.int64)  # rounding may lead just beyond 1
        for _, _, m in tiles(batches):
            m += 1
            m *= BINS / 2
            counts += np.bincount(m.astype(np.int32).ravel(), minlength=BINS + 2)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bin": at, "n": counts[at]})

    counts = np.zeros(BINS + 2, dtype=np.int64)
    for part in passes(histogram, "bin int, n bigint"):
        for b, m in part.groupBy("bin").agg(F.sum("n")).collect():
            counts[b] += m
    # The percentile lies between these two of the sorted cosines.
    rank = (total - 1) * share
    lower, upper = math.floor(rank), math.ceil(rank)
    bins = np.searchsorted(np.cumsum(counts), [lower, upper], side="right")
    # Rounding may have moved a cosine in each of the passes.
    off = rounding(dim)
    low, high = bins[0] * 2 / BINS - 1 - 2 * off, (bins[1] + 1) * 2 / BINS - 1 + 2 * off

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above, got, size = 0, [np.empty(0)], 0

        def out() -> pd.DataFrame:
            v, m = np.unique(np.concatenate(got), return_counts=True)
            return pd.DataFrame({"cosine": np.append(v, 2.0), "n": np.append(m, above)})

        for a, c, m in tiles(batches):
            m = m.ravel()
            at = np.flatnonzero(m >= low)
            sure = m[at] > high
            above += int(np.count_nonzero(sure))
            i, j = np.divmod(at[~sure], len(c))
            got.append(exact_cosines(a, i, c, j))
            size += len(got[-1])
            if size > 1 << 20:
                yield out()
                above, got, size = 0, [np.empty(0)], 0
        yield out()

    # Those surely above stand as cosines of 2.
    found = [cut(x.groupBy("cosine").agg(F.sum("n").alias("n"))) for x in passes(near, "cosine double, n bigint")]
    values = found[0]
    for x in found[1:]:
        values = values.unionByName(x)
    values = values.filter("n > 0")
    if parts > 1:
        values = cut(values.groupBy("cosine").agg(F.sum("n").alias("n")))
    a, b = (_value_at(values, total - 1 - k, most) for k in (lower, upper))
    bar = a if a == b else a * (1 - (rank - lower)) + b * (rank - lower)
    return values.filter(F.col("cosine") >= bar).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
