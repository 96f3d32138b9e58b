"""Streams over files that are taken up as they come: counts by key and rows
dropped that came before. Extensions: the batch results are the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice.plans.lineage import shared_dir
from tasklattice.sources.files import exists


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet files of ``path`` (a file or a folder)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    one = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory():
        return one.parquet(path)
    return one.option("pathGlobFilter", name).parquet(folder)


def appended(spark: SparkSession, path: str, place: str) -> DataFrame:
    """(event_type, n, total) of the events, which arrive as two sets of files in
    ``place``: the query runs on the first, ends, and starts again from its
    checkpoint on both. Files it has seen are not read again."""
    rows = spark.read.parquet(path)
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    result = None
    for k in (0, 1):
        rows.filter(half == k).write.mode("append").parquet(f"{place}/in")
        grouped = spark.readStream.schema(rows.schema).parquet(f"{place}/in").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        result = spark.read.parquet(_run(spark, grouped, "complete", f"{place}/run"))
    return result


def resumed(rows: DataFrame, key: str, chunks: list, step, place: str, stop_after: int | None = None) -> DataFrame:
    """``step`` of each chunk of ``rows``, written under its number in ``place``.
    A chunk whose folder holds the mark of a finished write is not done again, so
    a run that was stopped goes on where it stopped."""
    spark = rows.sparkSession
    for k in chunks[:stop_after]:
        at = f"{place}/done={k}"
        if not exists(spark, f"{at}/_SUCCESS"):
            step(rows.filter(F.col(key) == k)).write.mode("overwrite").parquet(at)
    return spark.read.parquet(place).drop("done")


def _run(spark: SparkSession, df: DataFrame, mode: str, place: str | None = None) -> str:
    place = place or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return f"{place}/out"


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, n, total), kept as state over the batches."""
    grouped = source(spark, path).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return spark.read.parquet(_run(spark, grouped, "complete"))


def deduplicated(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Events whose id was not seen within ``late`` before."""
    rows = source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return spark.read.parquet(_run(spark, rows, "append"))
