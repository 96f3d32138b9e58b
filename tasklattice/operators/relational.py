"""Filters, joins, sets and duplicates on tables of any size.

None of these collects rows; every "first" names the order it goes by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_in_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known and not listed."""
    return rows.filter(F.col(key).isNotNull()).join(ids, key, "left_anti")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; nulls are a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def union_by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of the first part that has the key, one row for each key."""
    tagged = [p.withColumn("src", F.lit(i)) for i, p in enumerate(parts)]
    return first_by(reduce(lambda a, b: a.unionByName(b), tagged), [key], [F.col("src")])


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new, key, "left_anti").unionByName(new)


def merge_ledger(ledger: DataFrame, failed: DataFrame, resolved: DataFrame, limit: int = 3) -> DataFrame:
    """(uid, attempts, status): failures count up and become ``needs_manual`` at
    ``limit``; resolved ones leave."""
    both = ledger.join(failed.select("uid", F.lit(1).alias("again")), "uid", "full")
    n = F.coalesce("attempts", F.lit(0)) + F.coalesce("again", F.lit(0))
    status = F.when(n >= limit, "needs_manual").when(F.col("again").isNotNull(), "failed").otherwise(F.coalesce("status", F.lit("pending")))
    return both.select("uid", n.cast("int").alias("attempts"), status.alias("status")).join(resolved, "uid", "left_anti")


def left_checked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that fails if a key is twice on the right (many to one)."""
    twice = right.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"keys {keys} are not unique on the right side")
    return left.join(right, keys, "left")


def crosswalk(rows: DataFrame, walk: DataFrame, code: str, target: str) -> DataFrame:
    """One row for each different target of the code, rows without one left out."""
    return rows.join(walk.select(code, target).distinct(), code).dropDuplicates()


def available_by_year(first: DataFrame, years: DataFrame, key: str) -> DataFrame:
    """``first`` holds key, item and first_year: each item in every year of its
    key from its first year on."""
    return first.join(years, key).filter(F.col("first_year") <= F.col("year"))


def calendar(rows: DataFrame, start: str, end: int) -> DataFrame:
    """A row for each year from ``start`` to ``end``."""
    return rows.withColumn("year", F.explode(F.sequence(F.col(start), F.greatest(F.lit(end), F.col(start)))))


def fallback(rows: DataFrame, levels: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """Take ``value`` from the first level that has it and name the level in
    ``match_level`` ('none' without). Levels must be unique by their keys."""
    out = rows
    for name, df, keys in levels:
        out = out.join(df.select(*keys, F.col(value).alias(f"_{name}")), keys, "left")
    level = F.lit(None).cast("string")
    for name, _, _ in reversed(levels):
        level = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(level)
    return out.withColumn(value, F.coalesce(*[F.col(f"_{n}") for n, _, _ in levels])).withColumn("match_level", F.coalesce(level, F.lit("none"))).drop(*[f"_{n}" for n, _, _ in levels])
