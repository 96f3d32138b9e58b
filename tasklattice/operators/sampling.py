"""Samples that come out the same in every run and on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _md5(c: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(c).cast("string"), F.lit(seed)).cast("binary"))


def entities(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """All rows of ``n`` entities, those with the least digest."""
    chosen = rows.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(_md5(key, seed), key).limit(n)
    return rows.join(chosen, key, "left_semi")


def bucket(key: str, n: int) -> Column:
    return (F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def whole_entities(rows: DataFrame, key: str, target: int, seed: str) -> DataFrame:
    """(key, n_rows, size_class) of whole entities, drawn in turn from the size
    classes (1, 2-9, 10-49, 50 and more rows) until ``target`` rows are reached.
    Only the classes' running totals are ordered, one row per entity."""
    sizes = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    n = F.col("n_rows")
    classed = sizes.withColumn("size_class", F.when(n < 2, 0).when(n < 10, 1).when(n < 50, 2).otherwise(3)).withColumn("draw", _md5(key, seed))
    within = Window.partitionBy("size_class").orderBy("draw", key)
    # No more entities than target rows can be needed from any class.
    turn = classed.withColumn("turn", F.row_number().over(within)).filter(F.col("turn") <= target)
    total = F.sum("n_rows").over(Window.orderBy("turn", "size_class").rowsBetween(Window.unboundedPreceding, -1))
    return turn.withColumn("before", F.coalesce(total, F.lit(0))).filter(F.col("before") < target).select(key, "n_rows", "size_class")
