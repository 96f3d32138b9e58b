"""Reading the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def settle(spark: SparkSession) -> None:
    """Turn off that a union reports its children's partitioning (new in Spark
    4.1): adaptive execution may give the children different numbers of
    partitions, and a join above then fails to plan."""
    if spark.conf.get("spark.sql.unionOutputPartitioning", "false") == "true":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
