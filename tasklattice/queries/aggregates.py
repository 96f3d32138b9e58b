"""Aggregations, rankings and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tasklattice.functions import vectors as V
from tasklattice.operators import exposure, panel
from tasklattice.queries.registry import Register
from tasklattice.sources.tables import table

q = Register()
QUERIES, SQL = q.queries, q.sql

JOBS = "stage6_jobs_linked__jobads_isco_variant"
_GOOD = "(select * from stage6_jobs_linked__jobads_isco_variant where exposure_score is not null and not isnan(exposure_score))"
_MATCH = "(select distinct o_custkey firm, l_suppkey app, l_partkey task, year(o_orderdate) yr from orders join lineitem on o_orderkey = l_orderkey)"


def _jobs(spark, d):
    return table(spark, d, JOBS).filter(F.col("exposure_score").isNotNull() & ~F.isnan("exposure_score"))


def _pairs(spark, d):
    return table(spark, d, "similarity_df").filter(F.col("similarity").isNotNull() & ~F.isnan("similarity"))


def _matches(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("firm"), F.col("l_suppkey").alias("app"), F.col("l_partkey").alias("task"), F.year("o_orderdate").alias("year")).distinct()


def _years(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()


@q("select company_id, year, count(*) as n from stage6_jobs_linked__jobads_isco_variant group by 1, 2")
def agg_count_group(spark, d):
    return table(spark, d, JOBS).groupBy("company_id", "year").agg(F.count("*").alias("n"))


@q("select company_id, sum(num_applications)::bigint as n_apps from (select distinct uid, company_id, num_applications from step1_output) group by 1")
def agg_apps_firm_year(spark, d):
    return table(spark, d, "step1_output").select("uid", "company_id", "num_applications").distinct().groupBy("company_id").agg(F.sum("num_applications").alias("n_apps"))


@q("select company_id, isco_code, min(year) as first_year from stage6_jobs_linked__jobads_isco_variant group by 1, 2")
def agg_first_year(spark, d):
    return table(spark, d, JOBS).groupBy("company_id", "isco_code").agg(F.min("year").alias("first_year"))


_SHARES = f"""m as {_MATCH}, f as (select firm, app, min(yr) fy from m group by 1, 2), y as (select distinct yr from m),
 av as (select f.firm, f.app, y.yr from f join y on f.fy <= y.yr), na as (select firm, yr, count(*) n_apps from av group by 1, 2),
 sh as (select av.firm, av.yr, p.task, count(*) n_matched from av join (select distinct firm, app, task from m) p on av.firm = p.firm and av.app = p.app group by 1, 2, 3)"""


@q(f"with {_SHARES} select sh.firm, sh.yr::int as year, count(*) as n_tasks, sum(n_matched)::bigint as n_matched, max(n_apps) as n_apps, round(sum(n_matched / n_apps), 6) as share_sum from sh join na on sh.firm = na.firm and sh.yr = na.yr group by 1, 2")
def agg_firm_task_share_tv(spark, d):
    s = exposure.firm_task_share(_matches(spark, d), _years(spark, d))
    return s.groupBy("firm", "year").agg(F.count("*").alias("n_tasks"), F.sum("n_matched").alias("n_matched"), F.max("n_apps").alias("n_apps"), F.round(F.sum("share"), 6).alias("share_sum"))


@q(f"with m as {_MATCH}, n as (select firm, count(distinct app) n_apps from m group by 1) select m.firm, task, round(count(distinct app) / max(n_apps), 8) as share from m join n on m.firm = n.firm group by 1, 2")
def agg_firm_task_share_ti(spark, d):
    m = _matches(spark, d)
    n = m.select("firm", "app").distinct().groupBy("firm").agg(F.count("*").alias("n_apps"))
    got = m.select("firm", "app", "task").distinct().groupBy("firm", "task").agg(F.count("*").alias("n"))
    return got.join(n, "firm").select("firm", "task", F.round(F.col("n") / F.col("n_apps"), 8).alias("share"))


@q(f"with {_SHARES}, t as (select p_brand, sum(p_size)::double w from part group by 1) select sh.firm, sh.yr::int as year, p.p_brand as occupation, max(n_apps) as n_apps, round(sum(n_matched / n_apps * p_size) / max(w), 8) as occ_exposure, round(ln(1 + max(n_apps)) * sum(n_matched / n_apps * p_size) / max(w), 8) as ai_exposure from sh join na on sh.firm = na.firm and sh.yr = na.yr join part p on sh.task = p.p_partkey join t on t.p_brand = p.p_brand group by 1, 2, 3")
def agg_weighted_occ(spark, d):
    weights = table(spark, d, "part").select(F.col("p_brand").alias("occupation"), F.col("p_partkey").alias("task"), F.col("p_size").cast("double").alias("weight"))
    out = exposure.occupation_exposure(exposure.firm_task_share(_matches(spark, d), _years(spark, d)), weights)
    return out.select("firm", "year", "occupation", "n_apps", F.round("occ_exposure", 8).alias("occ_exposure"), F.round("ai_exposure", 8).alias("ai_exposure"))


@q("select p_partkey, p_size / sum(p_size) over (partition by p_brand) as weight_norm from part")
def agg_norm_weights(spark, d):
    return exposure.normal_weights(table(spark, d, "part").withColumn("w", F.col("p_size").cast("double")), "p_brand", "w").select("p_partkey", "weight_norm")


@q("select p_brand, 1.0::double / count(distinct p_type) as weight from part group by 1")
def agg_equal_weights(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg((F.lit(1.0) / F.countDistinct("p_type")).alias("weight"))


@q("select p_brand, o_custkey % 50 as firm, round(avg(l_extendedprice) + 1e-6, 4) as mean_price, count(distinct p_partkey) as n_tasks from lineitem join part on l_partkey = p_partkey join orders on o_orderkey = l_orderkey group by 1, 2")
def agg_crosswalk_unweighted(spark, d):
    li, p, o = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("p_brand", (F.col("o_custkey") % 50).alias("firm")).agg(F.round(F.avg("l_extendedprice") + 1e-6, 4).alias("mean_price"), F.countDistinct("p_partkey").alias("n_tasks"))


@q("with a as (select l_suppkey, l_partkey, avg(l_discount) m from lineitem group by 1, 2) select n_nationkey, p_brand, round(sum(m * p_size) / sum(p_size), 8) as weighted from a join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2")
def agg_crosswalk_weighted(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.avg("l_discount").alias("m"))
    j = a.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_nationkey", "p_brand").agg(F.round(exposure.weighted_mean("m", "p_size"), 8).alias("weighted"))


@q("select p_type, (sum(p_retailprice * p_size) / sum(p_size)) as task_mean, count(*) as n_tasks, count_if(p_size > 25) as n_large from part group by 1")
def agg_task_to_onet(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(exposure.weighted_mean("p_retailprice", "p_size").alias("task_mean"), F.count("*").alias("n_tasks"), F.count_if(F.col("p_size") > 25).alias("n_large"))


@q(f"select isco_code, round(avg(exposure_score) + 1e-9, 6) as mean, min(exposure_score) as low, max(exposure_score) as high, coalesce(stddev_samp(exposure_score), 0) as sd, count(distinct company_id) as n_firms from {_GOOD} group by 1")
def agg_onet_to_isco(spark, d):
    e = "exposure_score"
    return _jobs(spark, d).groupBy("isco_code").agg(F.round(F.avg(e) + 1e-9, 6).alias("mean"), F.min(e).alias("low"), F.max(e).alias("high"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("sd"), F.countDistinct("company_id").alias("n_firms"))


@q("select onet_task_id, count(distinct ai_app_id) as n_apps, round(avg(similarity) + 1e-9, 6) as mean, median(similarity) as median, round(quantile_cont(similarity, 0.95) + 1e-9, 6) as p95 from similarity_df where similarity is not null and not isnan(similarity) group by 1")
def agg_task_summary(spark, d):
    return _pairs(spark, d).groupBy("onet_task_id").agg(F.countDistinct("ai_app_id").alias("n_apps"), F.round(F.avg("similarity") + 1e-9, 6).alias("mean"), F.percentile("similarity", 0.5).alias("median"), F.round(F.percentile("similarity", 0.95) + 1e-9, 6).alias("p95"))


@q("select app_text, onet_task_id, list_sort(list(distinct u)) as uids from (select app_text, onet_task_id, unnest(job_uid) u from similarity_df) group by 1, 2")
def agg_dedup_collect(spark, d):
    return table(spark, d, "similarity_df").select("app_text", "onet_task_id", F.explode("job_uid").alias("u")).groupBy("app_text", "onet_task_id").agg(F.sort_array(F.collect_set("u")).alias("uids"))


@q("select md5(content_clean) as text_hash, min(tst_created) as first_seen, arg_min(uid, (tst_created, uid)) as first_uid from job_postings_unified where content_clean is not null group by 1")
def agg_app_dedup(spark, d):
    rows = table(spark, d, "job_postings_unified").filter("content_clean is not null")
    return rows.groupBy(F.md5(F.col("content_clean").cast("binary")).alias("text_hash")).agg(F.min("tst_created").alias("first_seen"), F.min_by("uid", F.struct("tst_created", "uid")).alias("first_uid"))


@q("select quantile_cont(similarity, 0.95) as pct_5, quantile_cont(similarity, 0.9) as pct_10, quantile_cont(similarity, 0.8) as pct_20 from similarity_df where similarity is not null and not isnan(similarity)")
def agg_global_percentiles(spark, d):
    return _pairs(spark, d).agg(*[F.percentile("similarity", 1 - p / 100).alias(f"pct_{p}") for p in (5, 10, 20)])


@q("with t as (select quantile_cont(similarity, 0.9) t from similarity_df where similarity is not null and not isnan(similarity)) select ai_app_id, onet_task_id, bool_or(similarity >= t) as pct_10 from similarity_df, t where similarity is not null and not isnan(similarity) group by 1, 2")
def agg_add_pct_cols(spark, d):
    rows = _pairs(spark, d)
    t = rows.agg(F.percentile("similarity", 0.9).alias("t"))
    return rows.crossJoin(F.broadcast(t)).groupBy("ai_app_id", "onet_task_id").agg(F.bool_or(F.col("similarity") >= F.col("t")).alias("pct_10"))


@q("with g as (select onet_task_id, count(*) n, max(similarity) m from similarity_df where similarity is not null and not isnan(similarity) group by 1) select count(*) as n_tasks, avg(n) as mean_matches, avg(m) as mean_best, min(m) as least_best from g")
def agg_validation(spark, d):
    g = _pairs(spark, d).groupBy("onet_task_id").agg(F.count("*").alias("n"), F.max("similarity").alias("m"))
    return g.agg(F.count("*").alias("n_tasks"), F.avg("n").alias("mean_matches"), F.avg("m").alias("mean_best"), F.min("m").alias("least_best"))


@q("select min(cross_encoder_score) as low, max(cross_encoder_score) as high, stddev_pop(cross_encoder_score) as sd, corr(similarity, cross_encoder_score) as r from similarity_df where similarity is not null and not isnan(similarity) and cross_encoder_score is not null and not isnan(cross_encoder_score)")
def agg_ce_report(spark, d):
    c = "cross_encoder_score"
    rows = _pairs(spark, d).filter(F.col(c).isNotNull() & ~F.isnan(c))
    return rows.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.stddev_pop(c).alias("sd"), F.corr("similarity", c).alias("r"))


@q(f"with g as (select company_id, year, count(distinct title) n_titles, count(*) n_jobs, avg(exposure_score) e from {_GOOD} where company_id is not null group by 1, 2) select company_id, year, n_titles, n_jobs, round(e, 8) as mean_exposure, (sum(n_jobs) over (partition by company_id order by year rows unbounded preceding))::bigint as cumulative_jobs from g")
def agg_firm_report(spark, d):
    g = _jobs(spark, d).filter("company_id is not null").groupBy("company_id", "year").agg(F.countDistinct("title").alias("n_titles"), F.count("*").alias("n_jobs"), F.round(F.avg("exposure_score"), 8).alias("mean_exposure"))
    return g.withColumn("cumulative_jobs", panel.running("n_jobs", "company_id", ["year"]))


@q(f"select company_id, isco_code, year, avg(exposure_score) as mean_value, count(exposure_score) as n, case when grouping(isco_code) = 0 and grouping(year) = 0 and grouping(company_id) = 0 then 'company_id+isco_code+year' when grouping(company_id) = 0 and grouping(isco_code) = 0 then 'company_id+isco_code' when grouping(company_id) = 0 and grouping(year) = 0 then 'company_id+year' else 'isco_code+year' end as level from {_GOOD} group by grouping sets ((company_id, isco_code, year), (company_id, isco_code), (company_id, year), (isco_code, year))")
def agg_level_collapse(spark, d):
    sets = [["company_id", "isco_code", "year"], ["company_id", "isco_code"], ["company_id", "year"], ["isco_code", "year"]]
    return exposure.level_means(_jobs(spark, d), "exposure_score", sets, ["company_id", "isco_code", "year"])


@q(f"select company_id, round(avg(m) + 1e-9, 6) as firm_mean from (select company_id, isco_code, avg(exposure_score) m from {_GOOD} group by 1, 2) group by 1")
def agg_firm_level(spark, d):
    return _jobs(spark, d).groupBy("company_id", "isco_code").agg(F.avg("exposure_score").alias("m")).groupBy("company_id").agg(F.round(F.avg("m") + 1e-9, 6).alias("firm_mean"))


@q(f"select substring(isco_code, 1, 3) as isco3, year, sum(exposure_score * n) / sum(n) as mean from (select isco_code, year, avg(exposure_score) exposure_score, count(*) n from {_GOOD} where regexp_matches(isco_code, '^[0-9]{{4}}$') group by 1, 2) group by 1, 2")
def agg_isco_generic(spark, d):
    g = _jobs(spark, d).filter(F.col("isco_code").rlike("^[0-9]{4}$")).groupBy("isco_code", "year").agg(F.avg("exposure_score").alias("e"), F.count("*").alias("n"))
    return g.groupBy(F.substring("isco_code", 1, 3).alias("isco3"), "year").agg(exposure.weighted_mean("e", "n").alias("mean"))


@q("select year, count_if(exposure_score > 0.5) as n_high, count_if(exposure_score <= 0.5) as n_low, count_if(exposure_score is null or isnan(exposure_score)) as n_missing, count(distinct company_id) as n_firms from stage6_jobs_linked__jobads_isco_variant group by 1")
def agg_diagnostics(spark, d):
    e = F.when(~F.isnan("exposure_score"), F.col("exposure_score"))
    rows = table(spark, d, JOBS).withColumn("e", e)
    return rows.groupBy("year").agg(F.count_if(F.col("e") > 0.5).alias("n_high"), F.count_if(F.col("e") <= 0.5).alias("n_low"), F.count_if(F.col("e").isNull()).alias("n_missing"), F.countDistinct("company_id").alias("n_firms"))


@q(f"with g as (select isco_code, avg(exposure_score) m, count(*) n, sum(exposure_score) s from {_GOOD} group by 1), t as (select avg(exposure_score) mu, var_pop(exposure_score) * count(*) tot from {_GOOD}) select round(max(tot), 6) as ss_total, round(sum(n * (m - mu) * (m - mu)), 6) as ss_between, round(max(tot) - sum(n * (m - mu) * (m - mu)), 6) as ss_within from g, t")
def agg_var_decomp_ss(spark, d):
    rows = _jobs(spark, d)
    t = rows.agg(F.avg("exposure_score").alias("mu"), (F.var_pop("exposure_score") * F.count("*")).alias("tot"))
    g = rows.groupBy("isco_code").agg(F.avg("exposure_score").alias("m"), F.count("*").alias("n"))
    between = F.sum(F.col("n") * (F.col("m") - F.col("mu")) ** 2)
    return g.crossJoin(F.broadcast(t)).agg(F.round(F.max("tot"), 6).alias("ss_total"), F.round(between, 6).alias("ss_between"), F.round(F.max("tot") - between, 6).alias("ss_within"))


@q(f"with p as (select company_id, avg(exposure_score) m, var_samp(exposure_score) v from {_GOOD} where company_id is not null group by 1) select var_samp(m) as between_firms, avg(v) as within_firms, count(*) as n from p")
def agg_var_decomp_person(spark, d):
    p = _jobs(spark, d).filter("company_id is not null").groupBy("company_id").agg(F.avg("exposure_score").alias("m"), F.var_samp("exposure_score").alias("v"))
    return p.agg(F.var_samp("m").alias("between_firms"), F.avg("v").alias("within_firms"), F.count("*").alias("n"))


@q(f"select isco_code, count(*) as n, avg(exposure_score) as mean, stddev_samp(exposure_score) as sd, stddev_samp(exposure_score) / avg(exposure_score) as cv from {_GOOD} group by 1")
def agg_cv_stats(spark, d):
    e = "exposure_score"
    return _jobs(spark, d).groupBy("isco_code").agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("sd"), F.try_divide(F.stddev_samp(e), F.avg(e)).alias("cv"))


@q("select n_regionkey, avg(c_acctbal) as mean, median(c_acctbal) as median, stddev_samp(c_acctbal) as sd, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def agg_sector(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = "c_acctbal"
    return j.groupBy("n_regionkey").agg(F.avg(b).alias("mean"), F.percentile(b, 0.5).alias("median"), F.stddev_samp(b).alias("sd"), F.count("*").alias("n"))


@q("select year, count(distinct company_id) as n_firms, count(distinct isco_code) as n_occs, count(distinct (company_id, isco_code)) filter (company_id is not null and isco_code is not null) as n_pairs from stage6_jobs_linked__jobads_isco_variant group by 1")
def agg_universe(spark, d):
    return table(spark, d, JOBS).groupBy("year").agg(F.countDistinct("company_id").alias("n_firms"), F.countDistinct("isco_code").alias("n_occs"), F.countDistinct("company_id", "isco_code").alias("n_pairs"))


@q("select onet_task_id, count(*) as n, avg(similarity) as mean, min(similarity) as low, max(similarity) as high, min(onet_task) as task from similarity_df where similarity is not null and not isnan(similarity) group by 1 order by n desc, 1 limit 100")
def agg_task_stats(spark, d):
    s = "similarity"
    return _pairs(spark, d).groupBy("onet_task_id").agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.min(s).alias("low"), F.max(s).alias("high"), F.min("onet_task").alias("task")).orderBy(F.desc("n"), "onet_task_id").limit(100)


@q("with e as (select quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.75) b from part) select p_brand, count_if(p_retailprice >= b) as high, count_if(p_retailprice >= a and p_retailprice < b) as medium, count_if(p_retailprice < a) as low from part, e group by 1")
def agg_exposure_buckets(spark, d):
    rows = table(spark, d, "part")
    e = rows.agg(F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.75))).alias("e"))
    x, a, b = F.col("p_retailprice"), F.col("e")[0], F.col("e")[1]
    return rows.crossJoin(F.broadcast(e)).groupBy("p_brand").agg(F.count_if(x >= b).alias("high"), F.count_if((x >= a) & (x < b)).alias("medium"), F.count_if(x < a).alias("low"))


@q("select app_text, count(*) as n, median(similarity) as median, max(similarity) as best from similarity_df where similarity is not null and not isnan(similarity) group by 1")
def agg_app_stats(spark, d):
    return _pairs(spark, d).groupBy("app_text").agg(F.count("*").alias("n"), F.percentile("similarity", 0.5).alias("median"), F.max("similarity").alias("best"))


@q("with g as (select onet_task_id, count(*) n from similarity_df group by 1) select count(*) as n_tasks, count_if(n = 1) as n_single, count_if(n >= 5) as n_5, count_if(n >= 10) as n_10 from g")
def agg_match_summary(spark, d):
    g = table(spark, d, "similarity_df").groupBy("onet_task_id").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_tasks"), F.count_if(F.col("n") == 1).alias("n_single"), F.count_if(F.col("n") >= 5).alias("n_5"), F.count_if(F.col("n") >= 10).alias("n_10"))


@q("select onet_task_id, arg_max(app_text, (similarity, app_text)) as best_app, max(similarity) as best from similarity_df where similarity is not null and not isnan(similarity) group by 1")
def agg_task_breakdown(spark, d):
    return _pairs(spark, d).groupBy("onet_task_id").agg(F.max_by("app_text", F.struct("similarity", "app_text")).alias("best_app"), F.max("similarity").alias("best"))


@q("select quantile_cont(c_acctbal, 0.01) as p1, quantile_cont(c_acctbal, 0.05) as p5, quantile_cont(c_acctbal, 0.25) as p25, median(c_acctbal) as p50, quantile_cont(c_acctbal, 0.75) as p75, quantile_cont(c_acctbal, 0.95) as p95, quantile_cont(c_acctbal, 0.99) as p99, avg(c_acctbal) as mean, stddev_samp(c_acctbal) as sd from customer")
def agg_describe(spark, d):
    b = "c_acctbal"
    return table(spark, d, "customer").agg(*[F.percentile(b, p / 100).alias(f"p{p}") for p in (1, 5, 25, 50, 75, 95, 99)], F.avg(b).alias("mean"), F.stddev_samp(b).alias("sd"))


@q("select count(distinct company_id) as n_firms, count(distinct title) as n_titles, count(distinct uid) as n_ads, count(*) as n_rows from job_postings_unified")
def agg_dataset_stats(spark, d):
    return table(spark, d, "job_postings_unified").agg(F.countDistinct("company_id").alias("n_firms"), F.countDistinct("title").alias("n_titles"), F.countDistinct("uid").alias("n_ads"), F.count("*").alias("n_rows"))


@q("select corr(l_quantity, l_extendedprice) as quantity_price, corr(l_discount, l_tax) as discount_tax, corr(l_quantity, l_tax) as quantity_tax from lineitem")
def agg_corr_pearson(spark, d):
    return table(spark, d, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("quantity_price"), F.corr("l_discount", "l_tax").alias("discount_tax"), F.corr("l_quantity", "l_tax").alias("quantity_tax"))


@q("with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 b from part) select corr(a, b) as rho from r")
def agg_corr_spearman(spark, d):
    """Ranks are made from counts of the distinct values, which are ordered, not
    from one window over all rows."""
    rows = table(spark, d, "part")

    def ranks(c):
        n = rows.groupBy(c).agg(F.count("*").alias("n"))
        w = Window.orderBy(c)
        return n.withColumn(f"r_{c}", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") + (F.col("n") + 1) / 2.0).select(c, f"r_{c}")

    return rows.join(ranks("p_size"), "p_size").join(ranks("p_retailprice"), "p_retailprice").agg(F.corr("r_p_size", "r_p_retailprice").alias("rho"))


@q("select coalesce(o_orderpriority, 'All') as priority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p, count(*) as total from orders group by rollup (o_orderpriority)")
def agg_crosstab(spark, d):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(s.lower())
    return table(spark, d, "orders").rollup("o_orderpriority").agg(n("F"), n("O"), n("P"), F.count("*").alias("total")).select(F.coalesce("o_orderpriority", F.lit("All")).alias("priority"), "f", "o", "p", "total")


@q("select o_orderpriority, o_orderstatus, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct_total, 100.0 * count(*) / sum(count(*)) over (partition by o_orderpriority) as pct_row from orders group by 1, 2")
def agg_crosstab_pct(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.withColumn("pct_total", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("pct_row", 100.0 * panel.share("n", "o_orderpriority"))


@q("select year(o_orderdate)::int as year, avg(o_totalprice) filter (o_orderpriority = '1-URGENT') as urgent, avg(o_totalprice) filter (o_orderpriority = '5-LOW') as low from orders group by 1")
def agg_pivot_mean(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.avg("o_totalprice")).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@q("select year(o_orderdate)::int as year, count(*) as n, count(distinct o_custkey) as n_persons, quantile_cont(o_totalprice, 0.5) as median from orders group by 1")
def agg_structure(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_persons"), F.percentile("o_totalprice", 0.5).alias("median"))


@q("with e as (select quantile_cont(l_extendedprice, 1/3) a, quantile_cont(l_extendedprice, 2/3) b from lineitem) select case when l_extendedprice <= a then 'T1' when l_extendedprice <= b then 'T2' else 'T3' end as tercile, count(*) as n, avg(l_discount) as mean, stddev_samp(l_discount) as sd from lineitem, e group by 1")
def agg_tercile_means(spark, d):
    rows = table(spark, d, "lineitem")
    e = rows.agg(F.percentile("l_extendedprice", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"))
    x = F.col("l_extendedprice")
    t = F.when(x <= F.col("e")[0], "T1").when(x <= F.col("e")[1], "T2").otherwise("T3")
    return rows.crossJoin(F.broadcast(e)).groupBy(t.alias("tercile")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean"), F.stddev_samp("l_discount").alias("sd"))


@q("with p as (select o_custkey, bool_or(o_totalprice > 250000) a, bool_and(o_totalprice > 250000) b from orders group by 1) select case when b then 'always' when a then 'switcher' else 'never' end as class, count(*) as n from p group by 1")
def agg_person_classes(spark, d):
    hit = F.col("o_totalprice") > 250000
    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(hit).alias("a"), F.bool_and(hit).alias("b"))
    return p.groupBy(F.when(F.col("b"), "always").when(F.col("a"), "switcher").otherwise("never").alias("class")).agg(F.count("*").alias("n"))


@q("with f as (select o_custkey, min(year(o_orderdate)) g from orders where o_totalprice > 300000 group by 1), e as (select year(o_orderdate) - g t, o_totalprice v from orders join f using (o_custkey)) select t::int as event_time, avg(v) as mean, count(*) as n, stddev_samp(v) / sqrt(count(*)) as sem, avg(v) - (select avg(v) from e where t = -1) as from_base from e where t between -3 and 3 group by 1")
def agg_event_means(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    first = o.filter("o_totalprice > 300000").groupBy("o_custkey").agg(F.min("year").alias("g"))
    e = o.join(first, "o_custkey").withColumn("event_time", F.col("year") - F.col("g"))
    base = e.filter("event_time = -1").agg(F.avg("o_totalprice").alias("base"))
    g = e.filter("event_time between -3 and 3").groupBy("event_time").agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*"))).alias("sem"))
    return g.crossJoin(F.broadcast(base)).select("event_time", "mean", "n", "sem", (F.col("mean") - F.col("base")).alias("from_base"))


@q("select company_id, sum((ai_applications_raw is null)::int) / count(*) as rate from step1_output group by 1")
def agg_fp_rate(spark, d):
    return table(spark, d, "step1_output").groupBy("company_id").agg(F.avg(F.col("ai_applications_raw").isNull().cast("double")).alias("rate"))


@q("select w as keyword, count(*) as n from (select unnest(string_split(lower(title), ' ')) w from stage6_jobs_linked__jobads_isco_variant) where w <> '' group by 1 order by n desc, 1 limit 25")
def agg_top_keywords(spark, d):
    return table(spark, d, JOBS).select(F.explode(F.split(F.lower("title"), " ")).alias("keyword")).filter("keyword <> ''").groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(25)


@q("select source_folder, count(*) as n from job_postings_unified group by 1")
def agg_qa_counts(spark, d):
    return table(spark, d, "job_postings_unified").groupBy("source_folder").agg(F.count("*").alias("n"))


@q("select onet_task_id, min(onet_task) as task, count(distinct task_type) as n_types from similarity_df group by 1")
def agg_first_version(spark, d):
    return table(spark, d, "similarity_df").groupBy("onet_task_id").agg(F.min("onet_task").alias("task"), F.countDistinct("task_type").alias("n_types"))


@q("select app_text, onet_task_id from (select app_text, onet_task_id, count(*) n from similarity_df group by 1, 2) where n >= 2")
def agg_majority_vote(spark, d):
    return table(spark, d, "similarity_df").groupBy("app_text", "onet_task_id").agg(F.count("*").alias("n")).filter("n >= 2").select("app_text", "onet_task_id")


@q("with g as (select o_custkey k, list_distinct(list(o_orderpriority)) a, list_distinct(list(o_orderstatus)) s from orders group by 1) select k as o_custkey, len(list_intersect(a, ['1-URGENT','2-HIGH'])) / len(list_distinct(list_concat(a, ['1-URGENT','2-HIGH']))) as jaccard from g")
def math_jaccard(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"))
    return g.select("o_custkey", V.jaccard(F.col("a"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("jaccard"))


@q("with y as (select o_custkey, year(o_orderdate) y, sum(o_totalprice) v from orders group by 1, 2), e as (select o_custkey, arg_min(v, y) a, arg_max(v, y) b, max(y) - min(y) n from y group by 1) select o_custkey, case when a > 0 and b > 0 and n > 0 then pow(b / a, 1.0 / n) - 1 end as cagr from e")
def math_cagr(spark, d):
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    e = y.groupBy("o_custkey").agg(F.min_by("v", "y").alias("a"), F.max_by("v", "y").alias("b"), (F.max("y") - F.min("y")).alias("n"))
    return e.select("o_custkey", V.growth(F.col("a"), F.col("b"), F.col("n")).alias("cagr"))


@q("select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def math_cosine(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    return e.join(nxt, F.col("vec_id") == F.col("a")).select("a", "b", F.round(V.cosine(F.col("embedding"), F.col("w")), 6).alias("cosine"))


@q("select vec_id, round(list_inner_product(embedding::double[], embedding::double[]) / list_inner_product(embedding::double[], embedding::double[]), 9) as length from embeddings")
def math_normalize_l2(spark, d):
    u = V.unit(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.dot(u, u), 9).alias("length"))


@q(f"select company_id, year, isco_code, exposure_score from (select *, row_number() over (partition by year order by exposure_score desc, link_id) rn from {_GOOD}) where rn <= 10")
def win_top_per_group(spark, d):
    return panel.top_per_group(_jobs(spark, d), ["year"], [F.desc("exposure_score"), F.col("link_id")], 10).select("company_id", "year", "isco_code", "exposure_score")


@q("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 25")
def sort_top_n(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@q(f"select company_id, sum(exposure_score) as total from {_GOOD} where company_id is not null group by 1 order by round(total, 6) desc, 1 limit 50")
def sort_rank_firms(spark, d):
    g = _jobs(spark, d).filter("company_id is not null").groupBy("company_id").agg(F.sum("exposure_score").alias("total"))
    return g.orderBy(F.desc(F.round("total", 6)), "company_id").limit(50)


@q(f"with g as (select isco_code, round(avg(exposure_score), 8) m from {_GOOD} where isco_code is not null group by 1) select isco_code, m as mean, 'top' as side from (select * from g order by m desc, isco_code limit 10) union all select isco_code, m, 'bottom' from (select * from g order by m, isco_code limit 10)")
def sort_rank_occ(spark, d):
    g = _jobs(spark, d).filter("isco_code is not null").groupBy("isco_code").agg(F.round(F.avg("exposure_score"), 8).alias("mean"))
    top, bottom = g.orderBy(F.desc("mean"), "isco_code").limit(10), g.orderBy("mean", "isco_code").limit(10)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


@q(f"select company_id, isco_code, round(avg(exposure_score), 8) as mean, count(*) as n from {_GOOD} where company_id is not null and isco_code is not null group by 1, 2 order by mean desc, company_id, isco_code limit 50")
def sort_rank_pairs(spark, d):
    g = _jobs(spark, d).filter("company_id is not null and isco_code is not null").groupBy("company_id", "isco_code").agg(F.round(F.avg("exposure_score"), 8).alias("mean"), F.count("*").alias("n"))
    return g.orderBy(F.desc("mean"), "company_id", "isco_code").limit(50)


