"""Shares of items by firm and year, weighted to occupations, spread by crosswalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _steps(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many come in each year, as one short list for each of ``keys``."""
    n = rows.groupBy(*keys, "first_year").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.collect_list(F.struct("first_year", "n")).alias(name))


def _up_to(steps: str, year: Column) -> Column:
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + F.when(x["first_year"] <= year, x["n"]).otherwise(0))


def firm_task_share(matches: DataFrame, years: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``matches`` has firm, app, task and year: (firm, year, task, n_apps,
    n_matched, share). An app counts for its firm from the first year it is seen
    in; the share is of the apps seen so far. Only tasks with a match have rows.
    ``years`` holds the years, or those of each firm. An app matches the tasks it
    has at its firm, or those of ``pairs`` (app, task), whatever the firm.

    Counts by first year are added up over the years of each firm and task, so no
    app is repeated for its years, however many a firm has.
    """
    first = matches.groupBy("firm", "app").agg(F.min("year").alias("first_year"))
    own = first.join(pairs, "app") if pairs is not None else first.join(matches.select("firm", "app", "task").distinct(), ["firm", "app"])
    by_firm = _steps(first, ["firm"], "apps")
    all_years = F.collect_set("year").alias("years")
    by_firm = by_firm.join(years.groupBy("firm").agg(all_years), "firm") if "firm" in years.columns else by_firm.crossJoin(F.broadcast(years.agg(all_years)))
    spread = _steps(own, ["firm", "task"], "matched").join(by_firm, "firm").select("firm", "task", "apps", "matched", F.explode("years").alias("year"))
    counted = spread.select("firm", "year", "task", _up_to("apps", F.col("year")).alias("n_apps"), _up_to("matched", F.col("year")).alias("n_matched"))
    return counted.filter(F.col("n_matched") > 0).withColumn("share", F.col("n_matched") / F.col("n_apps"))


def occupation_exposure(shares: DataFrame, weights: DataFrame) -> DataFrame:
    """``weights`` has occupation, task and weight. The weighted mean over all
    tasks of an occupation, those without a match counting 0:
    (firm, year, occupation, n_apps, occ_exposure, ai_exposure)."""
    total = weights.groupBy("occupation").agg(F.sum("weight").alias("total_weight"))
    got = shares.join(weights, "task").groupBy("firm", "year", "occupation").agg(F.sum(F.col("share") * F.col("weight")).alias("hit"), F.max("n_apps").alias("n_apps"))
    out = got.join(total, "occupation").withColumn("occ_exposure", F.try_divide("hit", "total_weight"))
    return out.select("firm", "year", "occupation", "n_apps", "occ_exposure", (F.log1p("n_apps") * F.col("occ_exposure")).alias("ai_exposure"))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return F.try_divide(F.sum(v * w), F.sum(w))


def normal_weights(rows: DataFrame, group: str, weight: str) -> DataFrame:
    """Weights that sum to 1 in each group; missing ones take the group's median."""
    w = Window.partitionBy(group)
    known = F.coalesce(F.col(weight), F.percentile(weight, 0.5).over(w))
    return rows.withColumn("_w", known).withColumn("weight_norm", F.try_divide("_w", F.sum("_w").over(w))).drop("_w")


def level_means(rows: DataFrame, value: str, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """Means of one value over several sets of keys in one pass; a dropped key is
    null and ``level`` names the kept ones."""
    parts = F.array(*[F.struct(*[(F.col(k) if k in s else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in keys], F.lit("+".join(s)).alias("level")) for s in sets])
    return rows.select(F.explode(parts).alias("g"), value).groupBy("g").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n")).select("g.*", "mean_value", "n")
