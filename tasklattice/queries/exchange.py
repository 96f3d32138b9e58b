"""Sources, sinks and casts: what is written is read again."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tasklattice.functions import occurrences as O
from tasklattice.functions import structured as S
from tasklattice.functions import text as T
from tasklattice.plans.lineage import shared_dir
from tasklattice.queries.registry import Register
from tasklattice.sources import files
from tasklattice.sources.tables import table

q = Register()
QUERIES, SQL = q.queries, q.sql

JOBS = "stage6_jobs_linked__jobads_isco_variant"


def _place(spark):
    return f"{shared_dir(spark)}/exchange-{uuid.uuid4().hex}"


_LINKED = "select link_id, title, isco_code, year from stage6_jobs_linked__jobads_isco_variant"


def _linked(spark, d):
    return table(spark, d, JOBS).select("link_id", "title", "isco_code", "year")


@q(_LINKED)
def source_csv_typed(spark, d):
    p = _place(spark)
    _linked(spark, d).write.option("header", True).option("escape", '"').option("nullValue", "\\N").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(p)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\\N").schema("link_id bigint, title string, isco_code string, year int").csv(p)


@q("select count(*) as n, count(distinct p_brand) as n_brands, sum(p_size)::bigint as size from part")
def source_csv_inferred(spark, d):
    p = _place(spark)
    files.write_csv(table(spark, d, "part"), p)
    return files.csv(spark, p, columns=["p_partkey", "p_brand", "p_size"]).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("n_brands"), F.sum("p_size").cast("bigint").alias("size"))


@q("select distinct trim(x28_code) as x28_code, trim(isco_19) as isco_19 from x28_isco_crosswalk where x28_code is not null and isco_19 is not null")
def source_csv_semicolon(spark, d):
    p = _place(spark)
    table(spark, d, "x28_isco_crosswalk").write.option("header", True).option("sep", ";").csv(p)
    return files.crosswalk(spark, p, "x28_code", "isco_19")


@q("select distinct k as keyword from (select lower(unnest([title_de, title_fr, title_it, title_en])) k from occupation_reference union all select strip_accents(lower(unnest([title_de, title_fr, title_it, title_en]))) from occupation_reference) where k is not null")
def source_csv_union_keywords(spark, d):
    k = table(spark, d, "occupation_reference").select(F.explode(F.array("title_de", "title_fr", "title_it", "title_en")).alias("t")).filter("t is not null")
    return k.select(F.explode(F.array(F.lower("t"), T.strip_accents(F.lower("t")))).alias("keyword")).distinct()


@q("select event_id, user_id, event_type, value from events")
def source_ndjson_gz(spark, d):
    p = _place(spark)
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.option("compression", "gzip").json(f"{p}/a")
    spark.createDataFrame([("{broken",), ("",)], "value string").coalesce(1).write.text(f"{p}/b")
    return files.ndjson(spark, p, "event_id bigint, user_id bigint, event_type string, value double").select("event_id", "user_id", "event_type", "value")


@q("select case when event_id % 2 = 0 then 'full' else 'update' end as source_folder, count(*) as n from events group by 1")
def source_recursive_listing(spark, d):
    """Rows by the folder they were found in."""
    p = _place(spark)
    rows = table(spark, d, "events").select("event_id")
    rows.filter("event_id % 2 = 0").write.json(f"{p}/full")
    rows.filter("event_id % 2 = 1").write.json(f"{p}/update")
    return files.ndjson(spark, p, "event_id bigint").groupBy("source_folder").agg(F.count("event_id").alias("n"))


@q("select ai_app_id, similarity from similarity_df where similarity >= 0.9 and not isnan(similarity)")
def source_parquet_masked(spark, d):
    return table(spark, d, "similarity_df").filter((F.col("similarity") >= 0.9) & ~F.isnan("similarity")).select("ai_app_id", "similarity")


@q("select ai_app_id, task_type from similarity_df")
def source_parquet_columns(spark, d):
    return table(spark, d, "similarity_df").select("ai_app_id", "task_type")


@q("select min(o_orderdate) as first, max(o_orderdate) as last, count(*) as n from orders")
def source_date_bounds(spark, d):
    return table(spark, d, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"))


@q("select isco_code, title_de from occupation_reference")
def source_excel_tasks(spark, d):
    """Through the pandas adapter, as a spreadsheet would come in."""
    return files.adapted(spark, pd.read_parquet, f"{d}/occupation_reference.parquet", columns=["isco_code", "title_de"])


@q("select company_id, year, isco_code, exposure_score from stage6_jobs_linked__jobads_isco_variant")
def source_exposure_contract(spark, d):
    return files.require(table(spark, d, JOBS), ["company_id", "year", "isco_code"]).select("company_id", "year", "isco_code", "exposure_score")


@q("select distinct uid, sha256(coalesce(content_clean, '')) as cache_key, ai_applications_raw as response from step1_output where ai_applications_raw is not null")
def source_json_cache(spark, d):
    p = _place(spark)
    rows = table(spark, d, "step1_output").withColumn("cache_key", F.sha2(F.coalesce("content_clean", F.lit("")), 256))
    rows.filter("ai_applications_raw is not null").select("cache_key", F.col("ai_applications_raw").alias("response")).distinct().write.mode("append").json(p)
    cache = spark.read.schema("cache_key string, response string").json(p)
    return rows.select("uid", "cache_key").join(cache, "cache_key").distinct()


@q(_LINKED)
def sink_parquet_zstd(spark, d):
    p = _place(spark)
    files.write_parquet(_linked(spark, d), p, by=["year"])
    return spark.read.parquet(p).select("link_id", "title", "isco_code", F.col("year").cast("int").alias("year"))


@q("select company_id, count(*) as n from stage6_jobs_linked__jobads_isco_variant group by 1")
def sink_csv_append(spark, d):
    p = _place(spark)
    rows = table(spark, d, JOBS).select("link_id", "company_id")
    for part in (rows.filter("link_id % 2 = 0"), rows.filter("link_id % 2 = 1")):
        part.write.mode("append").option("header", True).csv(p)
    return files.csv(spark, p, "link_id bigint, company_id bigint").groupBy("company_id").agg(F.count("*").alias("n"))


@q("select count(*) as n, count(distinct uid) as n_uids from (select distinct uid from job_postings_unified)")
def sink_upsert_ignore(spark, d):
    p = _place(spark)
    rows = table(spark, d, "job_postings_unified").select("uid", "title")
    files.append_new(rows.filter(F.col("uid") < "100000500000"), p, "uid")
    files.append_new(rows, p, "uid")
    return spark.read.parquet(p).agg(F.count("*").alias("n"), F.countDistinct("uid").alias("n_uids"))


@q("select distinct uid, title, company_id, company_is_recruiter, case when len(list_filter(cantons, lambda x: x is not null and x <> '')) > 0 then list_filter(cantons, lambda x: x is not null and x <> '') end as cantons from job_postings_unified")
def sink_table_ddl(spark, d):
    """Ads written as text and read back with their types."""
    raw = table(spark, d, "job_postings_unified").select("uid", "title", F.col("company_id").cast("string").alias("company_id"), F.col("company_is_recruiter").cast("string").alias("company_is_recruiter"), F.concat(F.lit("['"), F.array_join("cantons", "','"), F.lit("']")).alias("cantons"), F.date_format("tst_created", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("tst_created"))
    return files.typed_ads(raw).select("uid", "title", "company_id", "company_is_recruiter", "cantons").distinct()


@q("select distinct uid, company_is_recruiter as flag from job_postings_unified")
def cast_bool_text(spark, d):
    t = F.coalesce(F.col("company_is_recruiter").cast("string"), F.lit(""))
    return table(spark, d, "job_postings_unified").select("uid", t.try_cast("boolean").alias("flag")).distinct()


@q("select distinct uid, date_trunc('second', tst_created) as created from job_postings_unified")
def cast_timestamptz(spark, d):
    t = F.date_format("tst_created", "yyyy-MM-dd HH:mm:ss 'UTC'")
    return table(spark, d, "job_postings_unified").select("uid", F.try_to_timestamp(F.regexp_replace(t, " UTC$", "+00:00")).alias("created")).distinct()


@q("select distinct uid, strftime(tst_created, '%Y-%m-%d %H:%M:%S') || '+00:00' as created from job_postings_unified")
def cast_utc_suffix(spark, d):
    t = F.date_format("tst_created", "yyyy-MM-dd HH:mm:ss 'UTC'")
    return table(spark, d, "job_postings_unified").select("uid", F.regexp_replace(t, " UTC$", "+00:00").alias("created")).distinct()


_PART = f"regexp_replace(x, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"
_PARTS = f"""list_filter(list_transform(string_split(regexp_replace(x28_occupations, '[\\[\\]{{}}''"]', '', 'g'), ','), lambda x: {_PART}), lambda x: x <> '')"""


@q(f"select distinct uid, case when trim(x28_occupations) <> 'null' and len({_PARTS}) > 0 then {_PARTS} end as parts from job_postings_unified")
def cast_text_array(spark, d):
    return table(spark, d, "job_postings_unified").select("uid", T.text_array(F.col("x28_occupations")).alias("parts")).distinct()


@q()
def text_occurrences(spark, d):
    return O.occurrences(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


@q()
def text_fp_filter(spark, d):
    """Documents all of whose hits are cantons or other words."""
    hits = O.occurrences(table(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.count_if(F.col("kind").isin("technology", "context")).alias("n_real")).withColumn("dropped", F.col("n_real") == 0)


_UNITS = ("ml", "wochen", "semaines", "settimane", "weeks")


@q(" union all ".join(f"select doc_id, '{w}' as unit from documents where regexp_matches(lower(text), '\\b{w}\\b|[0-9]{w}\\b') and len(regexp_extract_all(lower(text), '\\b{w}\\b|[0-9]{w}\\b')) = len(regexp_extract_all(lower(text), '[0-9]\\s*{w}\\b'))" for w in _UNITS))
def text_ml_after_number(spark, d):
    """Documents in which a word is only a unit behind numbers."""
    unit = F.explode(F.filter(F.array(*[F.when(T.only_after_numbers(F.col("text"), w), F.lit(w)) for w in _UNITS]), lambda x: x.isNotNull()))
    return table(spark, d, "documents").select("doc_id", unit.alias("unit"))


@q("with w as (select distinct uid, regexp_matches(' ' || lower(content_clean) || ' ', ' (maschinen|modelle|sensordaten) ') hit from job_postings_unified where content_clean is not null) select uid from w where hit")
def text_keyword_simple(spark, d):
    hit = F.concat(F.lit(" "), F.lower("content_clean"), F.lit(" ")).rlike(" (maschinen|modelle|sensordaten) ")
    return table(spark, d, "job_postings_unified").filter(hit).select("uid").distinct()


@q()
def json_repair(spark, d):
    from collections.abc import Iterator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"uid": b["uid"], "repaired": [S.repaired(x) for x in b["t"]]})

    rows = table(spark, d, "step1_output").select("uid", F.col("ai_applications_raw").alias("t")).distinct()
    return rows.mapInPandas(run, "uid bigint, repaired string")


@q()
def json_posexplode_tasks(spark, d):
    """One row per task with an id made of ad, statement and position."""
    t = S.exploded(table(spark, d, "step2_output").select("uid", "step2_output").distinct(), "uid", "step2_output")
    lines = t.select("uid", "position", F.posexplode(F.split("item", "\n")).alias("line", "task"))
    return lines.select(F.format_string("%d_cap%d_task%d", "uid", "position", F.col("line") + 1).alias("task_id"), F.col("uid").alias("original_job_uid"), "task")


@q()
def json_serialize_list(spark, d):
    t = S.exploded(table(spark, d, "step1_output").select("uid", "ai_applications_raw").distinct(), "uid", "ai_applications_raw")
    g = t.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("position", "item"))).alias("x"))
    return g.select("uid", F.to_json("x.item").alias("items"), F.size("x").alias("n_items"))


@q("select c_custkey, abs(c_acctbal - round(c_acctbal, 0)) <= 1e-6 + 1e-5 * abs(round(c_acctbal, 0)) as close from customer")
def math_isclose(spark, d):
    from tasklattice.functions.vectors import is_close

    return table(spark, d, "customer").select("c_custkey", is_close(F.col("c_acctbal"), F.round("c_acctbal", 0)).alias("close"))
