"""Regressions from distributed sums.

A design matrix never leaves the cluster: its cross products, and the sums of
scores by cluster, are aggregated, and only matrices with as many rows as there
are regressors reach the driver.

Conventions, fixed here: normal p-values; HC1 scales by N / (N - K); one-way
clusters by G / (G - 1) * (N - 1) / (N - K); two-way clusters are the sum of both
one-way forms less that of the pairs, unscaled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.operators.panel import demean_in_turn


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int

    def rows(self) -> list[tuple[str, float, float, float, int]]:
        out = []
        for name, b, s in zip(self.names, self.coef, self.se, strict=True):
            p = math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else float("nan")
            out.append((name, float(b), float(s), p, self.n))
        return out


SCHEMA = "term string, coef double, se double, p double, n bigint"


def complete(rows: DataFrame, cols: list[str]) -> DataFrame:
    rows = rows.dropna(subset=cols)
    for c in cols:
        if rows.schema[c].dataType.simpleString() in ("double", "float"):
            rows = rows.filter(~F.isnan(c))
    return rows


def _products(rows: DataFrame, x: list[str], y: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    k = len(x)
    sums = [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    more = [F.sum(F.col(c) * F.col(y)).alias(f"y{i}") for i, c in enumerate(x)] if y else []
    r = rows.agg(F.count("*").alias("n"), *sums, *more).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = r[f"x{i}_{j}"] or 0.0
    return m, np.array([r[f"y{i}"] or 0.0 for i in range(k)]) if y else np.zeros(k), r["n"]


def _meat(rows: DataFrame, x: list[str], clusters: list[str] | None) -> tuple[np.ndarray, int]:
    scores = [F.sum(F.col(c) * F.col("_e")).alias(f"_s{i}") for i, c in enumerate(x)]
    if clusters:
        rows = rows.groupBy(*clusters).agg(*scores)
    else:
        rows = rows.select(*[(F.col(c) * F.col("_e")).alias(f"_s{i}") for i, c in enumerate(x)])
    m, _, g = _products(rows, [f"_s{i}" for i in range(len(x))], None)
    return m, g


def ols(rows: DataFrame, y: str, x: list[str], fixed: list[str] = (), clusters: list[str] = (), constant: bool = True) -> Fit:
    """Least squares of ``y`` on ``x``. Columns named in ``fixed`` are taken out
    by demeaning, once each in their order; ``clusters`` holds none (HC1), one or
    two columns."""
    rows = complete(rows, [y, *x]).select(*{y, *x, *fixed, *clusters})
    rows = rows.withColumns({c: F.col(c).cast("double") for c in [y, *x]})
    names = list(x)
    if fixed:
        rows = demean_in_turn(rows, [y, *x], list(fixed))
    elif constant:
        rows = rows.withColumn("const", F.lit(1.0))
        names = ["const", *x]
    a, b, n = _products(rows, names, y)
    if n == 0:
        return Fit(names, np.full(len(names), np.nan), np.full(len(names), np.nan), 0)
    coef = np.linalg.lstsq(a, b, rcond=None)[0]
    bread = np.linalg.pinv(a)
    fitted = sum((F.col(c) * float(v) for c, v in zip(names, coef, strict=True)), F.lit(0.0))
    rows = rows.withColumn("_e", F.col(y) - fitted)
    k = len(names)
    if len(clusters) == 2:
        meat = sum(sign * _meat(rows, names, c)[0] for sign, c in ((1, [clusters[0]]), (1, [clusters[1]]), (-1, list(clusters))))
        scale = 1.0
    elif clusters:
        meat, g = _meat(rows, names, list(clusters))
        scale = g / max(1, g - 1) * (n - 1) / max(1, n - k)
    else:
        meat, _ = _meat(rows, names, None)
        scale = n / max(1, n - k)
    v = bread @ meat @ bread * scale
    return Fit(names, coef, np.sqrt(np.maximum(0, np.diag(v))), n)


def logit(rows: DataFrame, y: str, x: list[str], clusters: list[str] = (), rounds: int = 25) -> Fit:
    """Logit by Newton steps; each step is one aggregation."""
    rows = complete(rows, [y, *x]).withColumns({c: F.col(c).cast("double") for c in [y, *x]}).withColumn("const", F.lit(1.0))
    names = ["const", *x]
    beta = np.zeros(len(names))
    for _ in range(rounds):
        eta = sum((F.col(c) * float(v) for c, v in zip(names, beta, strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        k = len(names)
        cells = [F.sum(mu * (1 - mu) * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        r = rows.agg(F.count("*").alias("n"), *cells, *[F.sum((F.col(y) - mu) * F.col(c)).alias(f"g{i}") for i, c in enumerate(names)]).first()
        h = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = r[f"h{i}_{j}"] or 0.0
        step = np.linalg.lstsq(h, np.array([r[f"g{i}"] or 0.0 for i in range(k)]), rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    eta = sum((F.col(c) * float(v) for c, v in zip(names, beta, strict=True)), F.lit(0.0))
    meat, g = _meat(rows.withColumn("_e", F.col(y) - 1 / (1 + F.exp(-eta))), names, list(clusters) or None)
    bread = np.linalg.pinv(h)
    scale = g / max(1, g - 1) if clusters else 1.0
    return Fit(names, beta, np.sqrt(np.maximum(0, np.diag(bread @ meat @ bread * scale))), r["n"])


def benjamini_hochberg(rows: DataFrame, p: str, *order: str) -> DataFrame:
    """Adds ``p_adjusted``; the table of tests is small by nature (one row each)."""
    m = F.count("*").over(Window.partitionBy())
    ranked = rows.withColumn("_k", F.row_number().over(Window.orderBy(p, *order))).withColumn("_raw", F.col(p) * m / F.col("_k"))
    back = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_raw").over(back))).drop("_k", "_raw")
