"""Joins whose keys may be arbitrarily uneven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_groups_back(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, heavy: int = 50_000, most: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which holds one row per key and the
    number of its ``rows`` in ``size``.

    Keys with more than ``heavy`` rows are broadcast, and their rows stay where
    they are; of more than ``most`` such keys the largest ``most``, so that the
    broadcast side never grows beyond that, whatever the data. The other keys are
    joined by shuffle, where adaptive execution splits what is still uneven.
    """
    big = groups.filter(F.col(size) > heavy).orderBy(F.desc(size), *keys).limit(most)
    small = groups.join(F.broadcast(big.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(big), keys).unionByName(rows.join(small, keys))


def salt(n: int, *cols: str | Column) -> Column:
    """A number in [0, n) that depends on ``cols`` only, so a retried task deals
    its rows the same salts again."""
    return F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols]), F.lit(n)).cast("int")
