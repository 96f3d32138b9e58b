"""The most similar vectors for every vector, by a block matrix join.

Vectors are scaled to length one and quantised to whole numbers of eight bits with
one scale each; the length of what quantising leaves out is kept. The product of
two quantised vectors then differs from their cosine by no more than the sum of
the two remainders (plus their product). Groups of vectors meet as cells of a
triangular grid; inside a cell, tiles of quantised products are compared with the
k-th best cosine so far less the error bound. Only the pairs that can still win
are computed again from the vectors themselves in double precision. The best k of
each vector in each cell are merged into the best k of all.

The result is exact: nothing is pruned that could be among the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most numbers of a group (65,536 vectors of 64); a cell holds two groups.
GROUP_NUMBERS = 65_536 * 64
_TILE = 2048
#: Up to this length sums of products of eight-bit codes stay below 2 ** 24 and are
#: whole in single floats; beyond it double floats hold them.
_SINGLE = 2**24 // (127 * 127)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and lengths of the remainders of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(x - code * scale[:, None], axis=1)
    return code, scale, rest


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for (g, dim), part in b.groupby(["g", "dim"]):
            raw = np.stack(part["vec"].to_numpy()).astype(np.float32)
            yield pd.DataFrame([{"g": g, "dim": dim, "ids": part["id"].to_numpy(np.int64).tobytes(), "raw": raw.tobytes()}])


class _Side:
    """The vectors of one group, their codes, and the best so far of each."""

    def __init__(self, rows: pd.DataFrame, dim: int, k: int):
        # Rows come in any order: by the least key, so that a retried task does the same.
        rows = sorted(zip(rows["ids"], rows["raw"], strict=True))
        self.ids = np.frombuffer(b"".join(i for i, _ in rows), dtype=np.int64)
        self.raw = np.frombuffer(b"".join(r for _, r in rows), dtype=np.float32).reshape(-1, dim)
        n = len(self.ids)
        self.norm, self.scale, self.rest = np.empty(n), np.empty(n), np.empty(n)
        self.code = np.empty((n, dim), dtype=np.int8)
        for s in range(0, n, 4096):
            part = slice(s, s + 4096)
            wide = self.raw[part].astype(np.float64)
            self.norm[part] = np.linalg.norm(wide, axis=1)
            self.code[part], self.scale[part], self.rest[part] = quantise(wide / self.norm[part, None])
        self.best = np.full((n, k), -2.0)
        self.other = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, i: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> None:
        """Merge candidates into the best of their rows; of equal cosines the
        smaller id wins."""
        rows, at = np.unique(i, return_inverse=True)
        k = self.best.shape[1]
        r = np.concatenate((at, np.repeat(np.arange(len(rows)), k)))
        c = np.concatenate((cos, self.best[rows].ravel()))
        o = np.concatenate((ids, self.other[rows].ravel()))
        order = np.lexsort((o, -c, r))
        r, c, o = r[order], c[order], o[order]
        first = np.searchsorted(r, np.arange(len(rows)))
        take = first[:, None] + np.arange(k)
        self.best[rows], self.other[rows] = c[take], o[take]


def _exact(a: _Side, i: np.ndarray, b: _Side, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for s in range(0, len(i), 65_536):
        x, y = i[s : s + 65_536], j[s : s + 65_536]
        out[s : s + 65_536] = np.einsum("ij,ij->i", a.raw[x].astype(np.float64), b.raw[y].astype(np.float64)) / (a.norm[x] * b.norm[y])
    return out


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of the rows of two matrices of eight-bit codes, exactly."""
    kind = np.float32 if a.shape[1] <= _SINGLE else np.float64
    return a.astype(kind) @ b.astype(kind).T


def cell_best(left: _Side, right: _Side, same: bool) -> None:
    """Fill the best of both sides from all pairs of the cell. The tiles are
    products of eight-bit codes (whole numbers, kept in floats wide enough to hold
    them, as numpy multiplies matrices of floats only), which are then scaled; the
    slack covers the rounding of the scaling."""
    k = left.best.shape[1]
    slack = 1e-6
    for b0 in range(0, len(right.ids), _TILE):
        b1 = min(len(right.ids), b0 + _TILE)
        rscale = right.scale[b0:b1].astype(np.float32)
        rmax = right.rest[b0:b1].max()
        for a0 in range(0, b1 if same else len(left.ids), _TILE):
            a1 = min(len(left.ids), a0 + _TILE)
            tile = code_products(left.code[a0:a1], right.code[b0:b1]).astype(np.float32, copy=False)
            tile *= left.scale[a0:a1, None].astype(np.float32)
            tile *= rscale
            diagonal = same and a0 == b0
            if diagonal:
                np.fill_diagonal(tile, -2)
            lerr = left.rest[a0:a1] + rmax + left.rest[a0:a1] * rmax + slack
            lmax = left.rest[a0:a1].max()
            rerr = right.rest[b0:b1] + lmax + right.rest[b0:b1] * lmax + slack
            lbar, rbar = left.best[a0:a1, -1] - lerr, right.best[b0:b1, -1] - rerr
            for bars, err, axis in ((lbar, lerr, 1), (rbar, rerr, 0)):
                fresh = np.flatnonzero(bars < -1.5)
                if len(fresh) and tile.shape[axis] > k:  # the k-th best of the tile bounds rows that have none yet
                    sub = tile[fresh] if axis else tile[:, fresh].T
                    kth = -np.partition(-sub, k - 1, axis=1)[:, k - 1]
                    bars[fresh] = kth - 2 * err[fresh]
            i, j = np.nonzero(tile > lbar[:, None].astype(np.float32))
            # A diagonal tile holds each pair twice, so its rows are enough.
            p, q = (np.empty(0, np.int64),) * 2 if diagonal else np.nonzero(tile > rbar[None, :].astype(np.float32))
            if len(i):
                keep = tile[i, j] > -1.5
                i, j = i[keep] + a0, j[keep] + b0
                left.offer(i, right.ids[j], _exact(left, i, right, j))
            if len(p):
                p, q = p + a0, q + b0
                right.offer(q, left.ids[p], _exact(left, p, right, q))


def nearest(vectors: DataFrame, k: int = 5, key: str = "vec_id", column: str = "vec", group: int = GROUP_NUMBERS) -> DataFrame:
    """(a, b, cosine): for every vector its ``k`` others of the highest cosine;
    fewer where there are fewer. Of equal cosines those with smaller keys come
    first. Null and all-zero vectors, vectors holding nulls or NaN, and null keys
    take no part; vectors are compared with those of the same length only. Keys
    must be unique; repeated rows count once.

    Each vector is sent, as it is, to one row and one column of the grid, that is
    to groups + 1 cells, and quantised there. A group holds about ``group`` numbers
    at most, so that long vectors make smaller groups; the grid is as small as that
    and the number of cores allow.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.select(F.col(key).cast("bigint").alias("id"), F.col(column).cast("array<float>").alias("vec"))
        .filter(F.col("id").isNotNull() & F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
        .withColumn("dim", F.size("vec"))
    )
    # Repeated rows only make the grid finer, so they are counted without a shuffle.
    n, numbers = rows.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    side = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
    groups = max(math.ceil(numbers / group), min(side, math.ceil(n / 1024)), 1)
    own = rows.dropDuplicates(["id"])
    packed = own.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).mapInPandas(_pack, "g int, dim int, ids binary, raw binary")
    cells = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda h: F.least("g", h) * groups + F.greatest("g", h))
    spread = packed.withColumn("cell", F.explode(cells))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        g, h = divmod(int(pdf["cell"].iloc[0]), groups)
        dim = int(pdf["dim"].iloc[0])
        left = _Side(pdf[pdf["g"] == g], dim, k)
        right = left if g == h else _Side(pdf[pdf["g"] == h], dim, k)
        if len(left.ids) and len(right.ids):
            cell_best(left, right, g == h)
        out = [pd.DataFrame({"a": np.repeat(s.ids, k), "b": s.other.ravel(), "cosine": s.best.ravel()}) for s in ((left,) if g == h else (left, right))]
        all_ = pd.concat(out)
        return all_[all_["cosine"] > -1.5]

    best = spread.groupBy("cell", "dim").applyInPandas(join, "a bigint, b bigint, cosine double")
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("a", "b", "cosine")


def linked(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id_a, vec_id_b), vec_id_a < vec_id_b, where one is among the ``k``
    nearest of the other."""
    n = nearest(vectors, k)
    return n.select(F.least("a", "b").alias("vec_id_a"), F.greatest("a", "b").alias("vec_id_b")).distinct()
