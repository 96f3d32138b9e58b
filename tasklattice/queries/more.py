"""Smaller operators: further files, text marks, reports and estimates."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tasklattice.functions import keywords as K
from tasklattice.functions import models
from tasklattice.functions import occurrences as O
from tasklattice.functions import structured as S
from tasklattice.functions import text as T
from tasklattice.operators import estimators as E
from tasklattice.operators import panel, sampling, similarity, studies
from tasklattice.plans.lineage import cut, shared_dir
from tasklattice.queries.aggregates import _GOOD, _jobs, _pairs
from tasklattice.queries.estimators import _out, _panel
from tasklattice.queries.registry import Register
from tasklattice.sources import files
from tasklattice.sources.tables import table
from tasklattice.streaming import batches

q = Register()
QUERIES, SQL = q.queries, q.sql

JOBS = "stage6_jobs_linked__jobads_isco_variant"
_P = "p as (select o_custkey id, year(o_orderdate) yr, sum(o_totalprice) / 1e5 v, count(*) n from orders group by 1, 2)"
_GOOD_PAIRS = "(select * from similarity_df where similarity is not null and not isnan(similarity))"


def _place(spark):
    return f"{shared_dir(spark)}/exchange-{uuid.uuid4().hex}"


@q("select ai_app_id, onet_task_id from similarity_df where similarity >= 0.95 and not isnan(similarity)")
def source_parquet_rowgroups(spark, d):
    """A filtered scan; row groups are what the tasks of a scan read anyway."""
    return table(spark, d, "similarity_df").filter((F.col("similarity") >= 0.95) & ~F.isnan("similarity")).select("ai_app_id", "onet_task_id")


@q("select p_partkey, p_size from part where p_type like '%BRASS%' or p_size > 40")
def source_excel_statements(spark, d):
    df = files.adapted(spark, pd.read_parquet, f"{d}/part.parquet", columns=["p_partkey", "p_type", "p_size"])
    return df.filter(F.col("p_type").contains("BRASS") | (F.col("p_size") > 40)).select("p_partkey", F.col("p_size").cast("int").alias("p_size"))


@q("select s_suppkey, s_acctbal as importance_weight from supplier where s_nationkey < 10")
def source_excel_ratings(spark, d):
    return table(spark, d, "supplier").filter("s_nationkey < 10").select("s_suppkey", F.col("s_acctbal").alias("importance_weight"))


@q("select distinct trim(isco_19) as isco, substring(trim(x28_code), 1, 4) as head from x28_isco_crosswalk where length(trim(isco_19)) = 4")
def source_excel_bls(spark, d):
    w = table(spark, d, "x28_isco_crosswalk").select(F.trim("isco_19").alias("isco"), F.substring(F.trim("x28_code"), 1, 4).alias("head"))
    return w.filter(F.length("isco") == 4).distinct()


@q("select n_nationkey, try_cast(n_nationkey * 1000 as double) as employed from nation")
def source_excel_employment(spark, d):
    text = table(spark, d, "nation").select("n_nationkey", F.concat(F.format_number(F.col("n_nationkey") * 1000, 0), F.lit("#")).alias("t"))
    return text.select("n_nationkey", F.regexp_replace("t", "[,#]", "").try_cast("double").alias("employed"))


@q("select 'b.csv' as newest")
def source_latest_by_mtime(spark, d):
    p = _place(spark)
    for name in ("a.csv", "b.csv"):
        table(spark, d, "region").coalesce(1).write.csv(f"{p}/{name}")
    return spark.createDataFrame([(files.latest(spark, p, "*.csv").rsplit("/", 1)[-1],)], "newest string")


@q("select count(*) as n from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def source_temp_upload(spark, d):
    keys = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_semi").agg(F.count("*").alias("n"))


@q("select link_id from stage6_jobs_linked__jobads_isco_variant")
def sink_parquet_merge(spark, d):
    """Parts written apart are one table."""
    p = _place(spark)
    rows = table(spark, d, JOBS).select("link_id")
    for i in range(3):
        rows.filter(F.col("link_id") % 3 == i).write.mode("append").parquet(p)
    return spark.read.parquet(p)


@q("select link_id, year from stage6_jobs_linked__jobads_isco_variant")
def sink_export_select(spark, d):
    df = table(spark, d, JOBS)
    return df.select(*[c for c in ("link_id", "not_there", "year") if c in df.columns])


@q("select isco_code, count(*) as n from stage6_jobs_linked__jobads_isco_variant group by 1")
def sink_checkpoint_spec(spark, d):
    return cut(table(spark, d, JOBS).groupBy("isco_code").agg(F.count("*").alias("n")))


@q()
def text_unicode_norm(spark, d):
    """Compatibility form with plain dashes."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate({0x2013: "-", 0x2014: "-", 0x2212: "-"}))

    return table(spark, d, "documents").select("doc_id", nfkc("text").alias("text"))


@q()
def text_classify_occurrence(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return O.occurrences(docs, "doc_id", "text").groupBy("kind").agg(F.count("*").alias("n"))


_SOLE = ["modelle", "sql", "aa", "maschinen", "modèles", "modelli", "models"]


@q("with m as (select doc_id, lang, list_filter([" + ", ".join(f"case when regexp_matches(lower(text), '{T.word_pattern(t)}') then '{t}' end" for t in _SOLE) + "], lambda x: x is not null) as k from documents) select doc_id, len(k) = 1 and k[1] in ('aa', 'sql') and coalesce(lang, '') not in ('it', 'fr') as dropped from m where len(k) > 0")
def text_aa_language(spark, d):
    """Of the documents with keywords: whether to drop one whose only keyword is
    ambiguous, unless it is Italian or French."""
    rows = table(spark, d, "documents").select("doc_id", "lang", K.matched(F.col("text"), _SOLE).alias("k")).filter("k <> ''")
    return rows.select("doc_id", (F.col("k").isin("aa", "sql") & ~F.coalesce("lang", F.lit("")).isin("it", "fr")).alias("dropped"))


@q("select md5(string_agg(isco_code || title_en, '|' order by isco_code)) as h from occupation_reference")
def hash_texts_hash(spark, d):
    """A digest of an ordered list of a bounded reference table."""
    g = table(spark, d, "occupation_reference").agg(F.sort_array(F.collect_list(F.struct("isco_code", F.concat("isco_code", "title_en").alias("t")))).alias("x"))
    return g.select(F.md5(F.array_join("x.t", "|").cast("binary")).alias("h"))


@q("select onet_task_id, array_to_string(list_sort(list(distinct task_type)), '|') as types from similarity_df where task_type is not null group by 1")
def array_distinct_ordered(spark, d):
    return table(spark, d, "similarity_df").filter("task_type is not null").groupBy("onet_task_id").agg(F.array_join(F.sort_array(F.collect_set("task_type")), "|").alias("types"))


@q("select distinct uid, unnest(x28_industries) as industry from job_postings_unified")
def array_literal_eval(spark, d):
    text = F.concat(F.lit("['"), F.array_join("x28_industries", "', '"), F.lit("']"))
    rows = table(spark, d, "job_postings_unified").filter(F.size("x28_industries") > 0).select("uid", F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>").alias("x"))
    return rows.select("uid", F.explode("x").alias("industry")).distinct()


@q()
def json_double_decode(spark, d):
    r = F.col("ai_applications_raw")
    once = F.when(r.startswith('"'), F.element_at(F.from_json(F.concat(F.lit("["), r, F.lit("]")), "array<string>"), 1)).otherwise(r)
    return table(spark, d, "step1_output").select("uid", F.from_json(once, "array<string>").alias("items")).distinct().select("uid", F.size("items").alias("n_items"))


@q("select distinct uid from job_postings_unified where coalesce(trim(title), '') <> '' and coalesce(trim(company_name), '') <> '' and coalesce(trim(url), '') <> '' and tst_created is not null")
def json_build_row(spark, d):
    full = F.col("tst_created").isNotNull()
    for c in ("title", "company_name", "url"):
        full = full & (F.coalesce(F.trim(c), F.lit("")) != "")
    return table(spark, d, "job_postings_unified").filter(full).select("uid").distinct()


@q("select v as version, row_number() over (order by split_part(v, '.', 1)::int, split_part(v, '.', 2)::int)::int as place from (select distinct (p_size % 12)::varchar || '.' || (p_size % 5)::varchar v from part)")
def date_version_key(spark, d):
    v = table(spark, d, "part").select(F.concat_ws(".", (F.col("p_size") % 12).cast("string"), (F.col("p_size") % 5).cast("string")).alias("version")).distinct()
    parts = F.split("version", r"\.")
    return v.select("version", F.row_number().over(Window.orderBy(parts[0].cast("int"), parts[1].cast("int"))).alias("place"))


@q("select l_linestatus, stddev_samp(l_tax) / sqrt(count(*)) * 2.8 / stddev_samp(l_tax) as mde_sd from lineitem group by 1")
def math_mde(spark, d):
    from tasklattice.functions.vectors import detectable_effect

    sd = F.stddev_samp("l_tax")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg((detectable_effect(sd / F.sqrt(F.count("*"))) / sd).alias("mde_sd"))


@q("select o_orderkey, s.n as n_lines, c_mktsegment from orders left join (select l_orderkey, count(*) n from lineitem group by 1) s on o_orderkey = s.l_orderkey left join customer on o_custkey = c_custkey")
def join_aux_panel(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(n, "o_orderkey", "left").join(c, "o_custkey", "left").select("o_orderkey", "n_lines", "c_mktsegment")


@q("with a as (select vec_id, vec::double[] v from text_vectors where kind = 'app' and vec is not null and list_inner_product(vec::double[], vec::double[]) > 0), t as (select vec_id, vec::double[] v from text_vectors where kind = 'task' and vec is not null and list_inner_product(vec::double[], vec::double[]) > 0), p as (select list_cosine_similarity(a.v, t.v) c from a, t) select count(*) as n from p where c >= (select quantile_cont(c, 0.99) from p)")
def join_sim_exhaustive(spark, d):
    """Pairs in the best hundredth of all pairs, counted."""
    v = table(spark, d, "text_vectors")
    return similarity.reaching_percentile(v.filter("kind = 'app'"), v.filter("kind = 'task'"), 0.99)


@q("select o_orderkey, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 end as level from orders")
def join_lookup_map(spark, d):
    m = F.create_map(F.lit("1-URGENT"), F.lit(1), F.lit("2-HIGH"), F.lit(2))
    return table(spark, d, "orders").select("o_orderkey", F.try_element_at(m, F.col("o_orderpriority")).alias("level"))


@q("select user_id, count(*) as n from events group by 1")
def agg_accumulate(spark, d):
    """Counts of parts, added up."""
    e = table(spark, d, "events")
    parts = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.count("*").alias("n")).unionByName(e.filter("event_id % 2 = 1").groupBy("user_id").agg(F.count("*").alias("n")))
    return parts.groupBy("user_id").agg(F.sum("n").alias("n"))


@q("select isco_code, x28_code from (select distinct trim(isco_19) isco_code, trim(x28_code) x28_code from x28_isco_crosswalk) where isco_code in (select isco_code from occupation_reference)")
def agg_map_isco(spark, d):
    w = table(spark, d, "x28_isco_crosswalk").select(F.trim("isco_19").alias("isco_code"), F.trim("x28_code").alias("x28_code")).distinct()
    return w.join(table(spark, d, "occupation_reference").select("isco_code"), "isco_code", "left_semi")


@q("select " + ", ".join(f"quantile_cont(similarity, {1 - p / 100}) as pct_{p}" for p in (5, 10, 20)) + f" from {_GOOD_PAIRS} where ('0x' || substring(md5(ai_app_id || onet_task_id::varchar), 1, 2))::int < 128")
def agg_sampled_percentiles(spark, d):
    """Thresholds from the pairs whose hash falls into one half."""
    half = F.conv(F.substring(F.md5(F.concat("ai_app_id", F.col("onet_task_id").cast("string")).cast("binary")), 1, 2), 16, 10).cast("int") < 128
    return _pairs(spark, d).filter(half).agg(*[F.percentile("similarity", 1 - p / 100).alias(f"pct_{p}") for p in (5, 10, 20)])


@q(f"select substring(isco_code, 1, 2) as isco2, round(avg(exposure_score) + 1e-9, 6) as mean from {_GOOD} where regexp_matches(isco_code, '^[0-9]{{4}}$') group by 1")
def agg_isco_2d(spark, d):
    return _jobs(spark, d).filter(F.col("isco_code").rlike("^[0-9]{4}$")).groupBy(F.substring("isco_code", 1, 2).alias("isco2")).agg(F.round(F.avg("exposure_score") + 1e-9, 6).alias("mean"))


@q(f"select substring(isco_code, 1, 3) as isco3, round(avg(exposure_score) + 1e-9, 6) as mean from {_GOOD} where regexp_matches(isco_code, '^[0-9]{{4}}$') group by 1")
def agg_isco_3d(spark, d):
    return _jobs(spark, d).filter(F.col("isco_code").rlike("^[0-9]{4}$")).groupBy(F.substring("isco_code", 1, 3).alias("isco3")).agg(F.round(F.avg("exposure_score") + 1e-9, 6).alias("mean"))


@q(f"with {_P}, c as (select v - lag(v) over (partition by id order by yr) dv from p) select count(dv) as n, round(avg(dv), 6) as mean, round(stddev_samp(dv), 6) as sd, count_if(dv > 0) as n_gain, count_if(dv < 0) as n_loss from c")
def agg_expertise_summary(spark, d):
    dv = F.col("v") - F.lag("v").over(Window.partitionBy("id").orderBy("year"))
    return _panel(spark, d).select(dv.alias("dv")).agg(F.count("dv").alias("n"), F.round(F.avg("dv"), 6).alias("mean"), F.round(F.stddev_samp("dv"), 6).alias("sd"), F.count_if(F.col("dv") > 0).alias("n_gain"), F.count_if(F.col("dv") < 0).alias("n_loss"))


@q("with g as (select company_id, isco_code, row_number() over (partition by company_id order by count(*) desc, isco_code desc) as r from stage6_jobs_linked__jobads_isco_variant where isco_code is not null group by 1, 2) select company_id, isco_code as code from g where r = 1")
def agg_custom_cluster(spark, d):
    """The most frequent code of each firm; of equally frequent ones the last."""
    n = table(spark, d, JOBS).filter("isco_code is not null").groupBy("company_id", "isco_code").agg(F.count("*").alias("n"))
    return n.groupBy("company_id").agg(F.max_by("isco_code", F.struct("n", "isco_code")).alias("code"))


@q("with s as (select distinct uid, coalesce(step3_output, 'N/A') = 'N/A' a from step3_output), t as (select distinct uid, coalesce(step2_output, 'N/A') = 'N/A' b from step2_output) select case when a and b then 1.0 when a or b then 0.0 else 0.5 end::double as score, count(*) as n from s join t using (uid) group by 1")
def agg_na_aware_match(spark, d):
    na = lambda c: F.coalesce(F.col(c), F.lit("N/A")) == "N/A"
    a = table(spark, d, "step3_output").select("uid", na("step3_output").alias("a")).distinct()
    b = table(spark, d, "step2_output").select("uid", na("step2_output").alias("b")).distinct()
    score = F.when(F.col("a") & F.col("b"), 1.0).when(F.col("a") | F.col("b"), 0.0).otherwise(0.5)
    return a.join(b, "uid").groupBy(score.alias("score")).agg(F.count("*").alias("n"))


@q(f"with {_P}, c as (select id, yr, round(v - lag(v) over (partition by id order by yr), 9) dv from p) select id, yr::int as year, side from (select *, 'gain' side, row_number() over (order by dv desc, id, yr) r from c where dv is not null union all select *, 'loss', row_number() over (order by dv, id, yr) from c where dv is not null) where r <= 20")
def sort_rank_pair_expertise(spark, d):
    dv = F.round(F.col("v") - F.lag("v").over(Window.partitionBy("id").orderBy("year")), 9)
    c = _panel(spark, d).withColumn("dv", dv).filter("dv is not null")
    side = lambda o, name: c.orderBy(o, "id", "year").limit(20).select("id", "year", F.lit(name).alias("side"))
    return side(F.desc("dv"), "gain").unionByName(side(F.col("dv"), "loss"))


@q("select company_id from (select distinct company_id from job_postings_unified where company_id is not null) order by md5(company_id::varchar || 'firms'), company_id limit 30")
def sample_companies(spark, d):
    """Thirty firms, the same in every run and under any partitioning."""
    return sampling.entities(table(spark, d, "job_postings_unified").select("company_id"), "company_id", 30, "firms").distinct()


@q()
def dedup_semantic_pred(spark, d):
    return studies.greedy_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.9)


@q("select company_id, title, content_clean, min(uid) as uid from job_postings_unified where content_clean is not null and length(content_clean) > 50 group by 1, 2, 3")
def dedup_simple(spark, d):
    rows = table(spark, d, "job_postings_unified").filter("content_clean is not null and length(content_clean) > 50")
    return rows.groupBy("company_id", "title", "content_clean").agg(F.min("uid").alias("uid"))


@q("select link_id, case when year < 2018 then isco_code end as gate from stage6_jobs_linked__jobads_isco_variant")
def null_gate(spark, d):
    return table(spark, d, JOBS).select("link_id", F.when(F.col("year") < 2018, F.col("isco_code")).alias("gate"))


@q("select (select count(*) from job_postings_unified) as n_before, (select count(distinct uid) from job_postings_unified) as n_after, (select count(*) - count(distinct uid) from job_postings_unified) as n_lost")
def quality_coverage_log(spark, d):
    return table(spark, d, "job_postings_unified").agg(F.count("*").alias("n_before"), F.countDistinct("uid").alias("n_after"), (F.count("*") - F.countDistinct("uid")).alias("n_lost"))


def _grid(spark, rows, outcomes, x, specs):
    out = None
    for y in outcomes:
        for name, fixed in specs.items():
            one = _out(spark, E.ols(rows, y, x, fixed=fixed, clusters=["id"])).withColumns({"outcome": F.lit(y), "model": F.lit(name)})
            out = one if out is None else out.unionByName(one)
    return out


@q()
def est_pretreat(spark, d):
    return _out(spark, E.ols(_panel(spark, d).filter("year < 1998"), "v", ["n"], clusters=["id"]))


@q()
def est_occ_year(spark, d):
    p = _panel(spark, d).withColumn("nation_year", F.concat_ws("_", "c_nationkey", "year"))
    return _out(spark, E.ols(p, "v", ["n"], fixed=["nation_year", "id"], clusters=["id"]))


@q()
def est_income_fe(spark, d):
    p = _panel(spark, d).withColumn("nation_year", F.concat_ws("_", "c_nationkey", "year"))
    return _grid(spark, p, ["v"], ["n"], {"nation": ["c_nationkey"], "nation-year": ["nation_year"]})


@q()
def est_all_outcomes(spark, d):
    p = _panel(spark, d).withColumns({"log_v": F.log1p("v"), "big": (F.col("v") > 3).cast("double")})
    return _grid(spark, p, ["v", "log_v", "big"], ["n"], {"year": ["year"]})


@q()
def est_grid_intensive(spark, d):
    return _grid(spark, _panel(spark, d).filter("v > 1"), ["v"], ["n"], {"year": ["year"], "person": ["id"]})


@q()
def est_robust_specs(spark, d):
    p = _panel(spark, d).withColumn("next_v", panel.lag_if_next("v", "id", "year", -1))
    return _grid(spark, p, ["v", "next_v"], ["n"], {"year": ["year"], "nation, year": ["c_nationkey", "year"]})


@q()
def est_modules(spark, d):
    """Linear, quadratic and interacted terms."""
    m = _panel(spark, d).agg(F.avg("n").alias("mn")).first()[0] or 0.0
    p = _panel(spark, d).withColumn("c", F.col("n") - F.lit(float(m))).withColumns({"c2": F.col("c") * F.col("c"), "cy": F.col("c") * (F.col("year") - 1998)})
    out = None
    for name, x in {"linear": ["c"], "quadratic": ["c", "c2"], "interaction": ["c", "cy"]}.items():
        one = _out(spark, E.ols(p, "v", x, fixed=["year"], clusters=["id"])).withColumn("module", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@q()
def est_did_switcher(spark, d):
    p = _panel(spark, d)
    w = Window.partitionBy("id").orderBy("year")
    first = p.withColumn("pn", F.lag("n").over(w)).filter("n > pn").groupBy("id").agg(F.min("year").alias("g"))
    rows = p.join(first, "id", "left").withColumn("treated", F.col("g").isNotNull()).withColumn("t", F.coalesce(F.col("year") - F.col("g"), F.lit(99)))
    rows, x = studies.event_design(rows, "t", "treated", 2)
    return _out(spark, E.ols(rows, "v", x, fixed=["id", "year"], clusters=["id"]))


@q()
def udf_llm_filter(spark, d):
    r = models.completed(table(spark, d, "step2_output").select("uid", "step2_output").distinct(), "step2_output", models.EchoModel())
    return r.select("uid", S.malformed(F.col("response")).alias("reason"), F.size(F.from_json("response", "array<string>")).alias("n_kept"))


@q()
def udf_llm_score(spark, d):
    tasks = table(spark, d, "similarity_df").select(F.col("onet_task").alias("a"), F.lit("machine models and data").alias("b")).distinct()
    return models.scored(tasks, "a", "b", models.OverlapScorer()).select(F.col("a").alias("onet_task"), (1 + F.floor(F.col("score") * 9)).cast("int").alias("rating"))


@q("select event_type, count(*) as n, sum(value) as total from events group by 1")
def stream_micro_append(spark, d):
    """Events appended in two micro-batches; the second finds the state of the
    first, so the totals are those of one run over all of them."""
    return batches.appended(spark, f"{d}/events.parquet", _place(spark))


