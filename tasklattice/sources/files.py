"""Reading and writing files of the kinds the pipelines exchange.

Spark has no reader for spreadsheets and statistics packages; :func:`adapted`
takes them in through pandas on the driver, for small reference tables only.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of an ad as it is stored.
AD = "uid string, title string, company_id string, company_name string, company_is_recruiter string, cantons string, x28_occupations string, duplicate_group string, tst_created string, url string"


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header; without a schema the types are inferred, which
    reads it twice. Quoted fields may hold line breaks."""
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    return df.select(*columns) if columns else df


def crosswalk(spark: SparkSession, path: str, code: str, target: str, sep: str = ";") -> DataFrame:
    """Two trimmed text columns of a crosswalk, complete rows, all different."""
    schema = csv(spark, path, sep=sep).columns
    df = csv(spark, path, ", ".join(f"`{c}` string" for c in schema), sep)
    return df.select(F.trim(code).alias(code), F.trim(target).alias(target)).dropna().distinct()


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has the columns, else an error that names the missing ones."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one per line, compressed or not; lines that can't be read are left
    out. Folders are read with all they hold, and each row knows its file."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    file = F.col("_metadata.file_path")
    own = df.select("*", F.element_at(F.split(file, "/"), -2).alias("source_folder"), F.element_at(F.split(file, "/"), -1).alias("source_file"))
    return own.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def jdbc(spark: SparkSession, url: str, name: str, column: str, lower: str, upper: str, parts: int = 64, **options: str) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of ``column``."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=str(parts), **options).load()


def adapted(spark: SparkSession, read, *args, **kwargs) -> DataFrame:
    """A table that a pandas reader understands (a spreadsheet, a Stata file).
    NaN becomes null. It passes through the driver: for reference tables."""
    pdf = read(*args, **kwargs)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None)) if len(pdf) else spark.createDataFrame([], T.StructType([T.StructField(str(c), T.StringType()) for c in pdf.columns]))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest(spark: SparkSession, folder: str, pattern: str) -> str:
    """The newest file of ``folder`` that matches; an error lists what is there."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path)
    if not found:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return str(max(found, key=lambda s: (s.getModificationTime(), str(s.getPath()))).getPath())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, level: int = 9, by: list[str] | None = None) -> None:
    """Parquet under Zstandard, one folder for each value of ``by``."""
    w = df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
    (w.partitionBy(*by) if by else w).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Add the rows whose key isn't in the table yet, one for each key."""
    fresh = df.dropDuplicates([key])
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def typed_ads(raw: DataFrame) -> DataFrame:
    """Ads with their types: unreadable values become null, lists become arrays."""
    split = lambda c: F.filter(F.split(F.regexp_replace(c, r"[\[\]{}'\"]", ""), r"\s*,\s*"), lambda x: x != "")
    listed = lambda c: F.when(F.size(split(F.col(c))) > 0, split(F.col(c)))
    return raw.select("uid", "title", F.col("company_id").try_cast("bigint").alias("company_id"), F.col("company_is_recruiter").try_cast("boolean").alias("company_is_recruiter"), listed("cantons").alias("cantons"), F.try_to_timestamp(F.regexp_replace("tst_created", " UTC$", "+00:00")).alias("tst_created"))


def stem(path: str) -> str:
    return PurePosixPath(path).stem
