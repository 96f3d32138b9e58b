"""The session settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cores}]").appName("tasklattice")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions or cores), **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
