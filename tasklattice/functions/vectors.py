"""Vectors and small maths on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of length zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def jaccard(a: Column, b: Column) -> Column:
    """1 where both sets are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def growth(first: Column, last: Column, years: Column) -> Column:
    """Compound yearly growth, null unless both ends and the span are positive."""
    ok = (first > 0) & (last > 0) & (years > 0)
    return F.when(ok, F.pow(last / first, 1.0 / years) - 1)


def is_close(a: Column, b: Column, atol: float = 1e-6, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def detectable_effect(se: Column) -> Column:
    """Least effect found with 80 % power at the 5 % level."""
    return se * (1.96 + 0.84)
