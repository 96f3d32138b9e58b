"""Windows over panels: one entity, ordered years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(entity: str, year: str) -> Window:
    return Window.partitionBy(entity).orderBy(year)


def lag_if_next(value: str, entity: str, year: str, step: int = 1) -> Column:
    """The value of the year before (after, for a negative step), null across a
    gap."""
    w = _by(entity, year)
    return F.when(F.col(year) - F.lag(year, step).over(w) == step, F.lag(value, step).over(w))


def difference(value: str, entity: str, year: str) -> Column:
    return F.col(value) - lag_if_next(value, entity, year)


def filled_blocks(rows: DataFrame, entity: str, order: str, value: str, reset: Column) -> DataFrame:
    """``value`` carried forward within blocks; a block begins at each row where
    ``reset`` holds."""
    w = _by(entity, order).rowsBetween(Window.unboundedPreceding, 0)
    block = rows.withColumn("_block", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w))
    inner = Window.partitionBy(entity, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return block.withColumn(f"{value}_filled", F.last(value, ignorenulls=True).over(inner)).drop("_block")


def demeaned(value: str, *groups: str) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*groups))


def demean_in_turn(rows: DataFrame, values: list[str], groups: list[str]) -> DataFrame:
    """One pass over the groups in their order (no iteration to convergence)."""
    for g in groups:
        rows = rows.withColumns({v: demeaned(v, g) for v in values})
    return rows


def running(value: str, entity: str, order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def average_rank(value: str, *groups: str) -> Column:
    """Ranks from the largest, ties share their average."""
    w = Window.partitionBy(*groups) if groups else Window.partitionBy()
    ties = Window.partitionBy(*groups, value)
    return F.rank().over(w.orderBy(F.desc(value))) + (F.count("*").over(ties) - 1) / 2.0


def share(value: str, *groups: str) -> Column:
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*groups)))
