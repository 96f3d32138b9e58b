"""Further joins, aggregates, evaluations and estimates of the studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tasklattice.functions import models
from tasklattice.functions import structured as S
from tasklattice.functions import text as T
from tasklattice.operators import estimators as E
from tasklattice.operators import exposure, panel, relational, studies
from tasklattice.queries.aggregates import _GOOD, _MATCH, _jobs, _matches, _pairs, _years
from tasklattice.queries.estimators import _out, _panel
from tasklattice.queries.registry import Register
from tasklattice.sources.tables import table

q = Register()
QUERIES, SQL = q.queries, q.sql

JOBS = "stage6_jobs_linked__jobads_isco_variant"
_SIM = "(select * from similarity_df where similarity is not null and not isnan(similarity))"
_P = "p as (select o_custkey id, year(o_orderdate) yr, sum(o_totalprice) / 1e5 v, count(*) n from orders group by 1, 2)"


@q("select c_custkey, case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 end as code from customer")
def project_sex_map(spark, d):
    c = F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", F.when(c == "BUILDING", 0).when(c == "MACHINERY", 1).alias("code"))


@q("select s_suppkey, case when s_acctbal >= 0 then s_acctbal end as balance from supplier")
def project_recode_negative(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance"))


@q("select o_orderkey, case when o_orderstatus in ('F','O') then (o_orderstatus = 'F')::int end as voted from orders")
def project_vote_dummies(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s.isin("F", "O"), (s == "F").cast("int")).alias("voted"))


@q("with m as (select avg(p_size) m from part) select p_partkey, round(p_size - m, 6) as centred, round((p_size - m) * (p_size - m), 6) as squared from part, m")
def project_controls(spark, d):
    rows = table(spark, d, "part")
    m = rows.agg(F.avg("p_size").alias("m"))
    x = F.col("p_size") - F.col("m")
    return rows.crossJoin(F.broadcast(m)).select("p_partkey", F.round(x, 6).alias("centred"), F.round(x * x, 6).alias("squared"))


@q("select o_orderkey, (year(o_orderdate) = 1996)::int as y1996, (year(o_orderdate) = 1997)::int as y1997, (year(o_orderdate) = 1998)::int as y1998 from orders")
def project_year_dummies(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", *[(y == n).cast("int").alias(f"y{n}") for n in (1996, 1997, 1998)])


@q("select c_custkey, (c_custkey + 13) * 13 as firm_id from customer")
def project_firm_id_encode(spark, d):
    return table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") + 13) * 13).alias("firm_id"))


@q("select (c_custkey + 13) * 13 as firm_id, c_custkey from customer")
def project_firm_id_decode(spark, d):
    firms = table(spark, d, "customer").select(((F.col("c_custkey") + 13) * 13).alias("firm_id"))
    return firms.select("firm_id", (F.expr("firm_id div 13") - 13).alias("c_custkey"))


@q(f"select company_id, year, avg(exposure_score) as exposure_p20_ce08 from {_GOOD} group by 1, 2")
def project_spec_suffix_onet(spark, d):
    g = _jobs(spark, d).groupBy("company_id", "year").agg(F.avg("exposure_score").alias("exposure"))
    return studies.spec_suffix(g, ["exposure"], "pct_20", "ce_0.8")


@q(f"select company_id, year, avg(exposure_score) as exposure from {_GOOD} group by 1, 2")
def project_spec_unsuffix_isco(spark, d):
    g = project_spec_suffix_onet(spark, d).withColumn("exposure_p10_ce00", F.lit(0.0))
    return studies.spec_select(g, "_p20_ce08")


@q("select title, link_id, year from stage6_jobs_linked__jobads_isco_variant")
def project_column_reorder(spark, d):
    df = table(spark, d, JOBS).select("link_id", "year", "title")
    return df.select("title", *[c for c in df.columns if c != "title"])


@q("with a as (select l_partkey, avg(l_discount) e from lineitem group by 1) select p_brand, avg(e) as mean from a join part on l_partkey = p_partkey group by 1")
def join_webb_inner(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_discount").alias("e"))
    return a.join(table(spark, d, "part"), "p_partkey").groupBy("p_brand").agg(F.avg("e").alias("mean"))


@q("select o_orderkey, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def join_panel_left(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    rows = relational.left_checked(table(spark, d, "orders"), c, ["o_custkey"])
    return relational.left_checked(rows, table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("o_orderkey", "n_name")


def _level(spark, d, digits):
    code = F.col("isco_code").rlike("^[0-9]{4}$")
    rows = _jobs(spark, d).filter(code & F.col("company_id").isNotNull())
    key = F.substring("isco_code", 1, digits)
    means = rows.groupBy("company_id", key.alias("code"), "year").agg(F.round(F.avg("exposure_score") + 1e-9, 6).alias("exposure"))
    jobs = table(spark, d, JOBS).filter(code).withColumn("code", key)
    return jobs.join(means, ["company_id", "code", "year"], "left").select("link_id", "exposure")


def _level_sql(n):
    return f"with m as (select company_id, substring(isco_code, 1, {n}) code, year, round(avg(exposure_score) + 1e-9, 6) e from {_GOOD} where company_id is not null and regexp_matches(isco_code, '^[0-9]{{4}}$') group by 1, 2, 3) select j.link_id, m.e as exposure from stage6_jobs_linked__jobads_isco_variant j left join m on j.company_id = m.company_id and substring(j.isco_code, 1, {n}) = m.code and j.year = m.year where regexp_matches(j.isco_code, '^[0-9]{{4}}$')"


@q(_level_sql(4))
def join_exposure_4d(spark, d):
    return _level(spark, d, 4)


@q(_level_sql(3))
def join_exposure_3d(spark, d):
    return _level(spark, d, 3)


@q(_level_sql(2))
def join_exposure_2d(spark, d):
    return _level(spark, d, 2)


@q(f"with i as (select distinct company_id, unnest(x28_industries) industry from job_postings_unified where company_id is not null), e as (select company_id, avg(exposure_score) m from {_GOOD} group by 1) select industry, count(*) as n, round(avg(m) + 1e-9, 6) as mean from i join e using (company_id) group by 1")
def join_sector(spark, d):
    i = table(spark, d, "job_postings_unified").filter("company_id is not null").select("company_id", F.explode("x28_industries").alias("industry")).distinct()
    e = _jobs(spark, d).groupBy("company_id").agg(F.avg("exposure_score").alias("m"))
    return i.join(e, "company_id").groupBy("industry").agg(F.count("*").alias("n"), F.round(F.avg("m") + 1e-9, 6).alias("mean"))


@q("select distinct uid from job_postings_unified where uid not in (select uid::varchar from step1_output)")
def join_anti_seed(spark, d):
    seed = table(spark, d, "step1_output").select(F.col("uid").cast("string").alias("uid"))
    return table(spark, d, "job_postings_unified").join(seed, "uid", "left_anti").select("uid").distinct()


@q(f"select s.app_text, s.onet_task_id, max(c.cross_encoder_score) as score from {_SIM} s left join (select app_text, onet_task_id, cross_encoder_score from similarity_df where cross_encoder_score is not null and not isnan(cross_encoder_score)) c using (app_text, onet_task_id) group by 1, 2")
def join_score_merge(spark, d):
    c = table(spark, d, "similarity_df").filter(F.col("cross_encoder_score").isNotNull() & ~F.isnan("cross_encoder_score")).groupBy("app_text", "onet_task_id").agg(F.max("cross_encoder_score").alias("score"))
    return _pairs(spark, d).select("app_text", "onet_task_id").distinct().join(c, ["app_text", "onet_task_id"], "left")


@q(f"with t as (select onet_task_id, min(onet_task) task from similarity_df group by 1) select s.ai_app_id, s.onet_task_id, t.task from (select distinct ai_app_id, onet_task_id from {_SIM}) s left join t using (onet_task_id)")
def join_task_meta(spark, d):
    t = table(spark, d, "similarity_df").groupBy("onet_task_id").agg(F.min("onet_task").alias("task"))
    return _pairs(spark, d).select("ai_app_id", "onet_task_id").distinct().join(t, "onet_task_id", "left")


@q("with a as (select app_text, onet_task_id, max(similarity) m from similarity_df where not isnan(similarity) group by 1, 2), b as (select app_text, onet_task_id, min(similarity) n from similarity_df where not isnan(similarity) group by 1, 2) select count(*) as n_pairs, count_if(m is distinct from n) as n_differ from a join b using (app_text, onet_task_id)")
def join_integrity(spark, d):
    g = _pairs(spark, d).groupBy("app_text", "onet_task_id")
    a, b = g.agg(F.max("similarity").alias("m")), g.agg(F.min("similarity").alias("n"))
    return a.join(b, ["app_text", "onet_task_id"]).agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("m").eqNullSafe(F.col("n"))).alias("n_differ"))


@q()
def join_collision(spark, d):
    """Firms' names that are the same without legal form, case and accents."""
    n = table(spark, d, "job_postings_unified").filter("company_name is not null").select("company_name").distinct().withColumn("norm", T.normalize_firm(F.col("company_name")))
    g = n.groupBy("norm").agg(F.count("*").alias("n_names"))
    return g.filter("n_names > 1 and norm <> ''")


@q(f"with m as {_MATCH}, f as (select firm, app, min(yr) fy from m group by 1, 2) select fy::int as first_year, count(*) as n from f group by 1")
def agg_precalc_counts(spark, d):
    f = _matches(spark, d).groupBy("firm", "app").agg(F.min("year").alias("first_year"))
    return f.groupBy("first_year").agg(F.count("*").alias("n"))


@q(f"with m as {_MATCH}, na as (select yr, count(distinct app) n_apps from m group by 1), t as (select yr, task, count(distinct app) n from m group by 1, 2) select t.yr::int as year, task, round(n / n_apps, 8) as share from t join na on t.yr = na.yr")
def agg_occ_expand_pure(spark, d):
    m = _matches(spark, d)
    na = m.select("year", "app").distinct().groupBy("year").agg(F.count("*").alias("n_apps"))
    t = m.select("year", "task", "app").distinct().groupBy("year", "task").agg(F.count("*").alias("n"))
    return t.join(na, "year").select("year", "task", F.round(F.col("n") / F.col("n_apps"), 8).alias("share"))


@q("select p_brand, sum(p_retailprice * p_size) / sum(p_size) as baseline, sum(case when p_size < 25 then p_retailprice * p_size end) / sum(case when p_size < 25 then p_size end) as remaining from part group by 1")
def agg_expertise(spark, d):
    low = F.col("p_size") < 25
    rest = F.try_divide(F.sum(F.when(low, F.col("p_retailprice") * F.col("p_size"))), F.sum(F.when(low, F.col("p_size"))))
    return table(spark, d, "part").groupBy("p_brand").agg(exposure.weighted_mean("p_retailprice", "p_size").alias("baseline"), rest.alias("remaining"))


@q("select substring(isco_code, 1, 2) as code, arg_min(title_en, isco_code) as title from occupation_reference group by 1")
def agg_titles(spark, d):
    return table(spark, d, "occupation_reference").groupBy(F.substring("isco_code", 1, 2).alias("code")).agg(F.min_by("title_en", "isco_code").alias("title"))


@q("select p_partkey, (l.n is not null)::int as exposed, coalesce(p_size::double, 3.0) as weight from part left join (select l_partkey, count(*) n from lineitem where l_discount > 0.09 group by 1) l on l_partkey = p_partkey")
def agg_task_table(spark, d):
    n = table(spark, d, "lineitem").filter("l_discount > 0.09").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "part").join(n, "p_partkey", "left").select("p_partkey", F.col("n").isNotNull().cast("int").alias("exposed"), F.coalesce(F.col("p_size").cast("double"), F.lit(3.0)).alias("weight"))


@q(f"with g as (select isco_code, avg(exposure_score) m from {_GOOD} group by 1), b as (select var_samp(m) v from g), t as (select var_samp(exposure_score) v from {_GOOD}) select round(b.v, 9) as between_groups, round(t.v - b.v, 9) as within_groups from b, t")
def agg_var_decomp_occ(spark, d):
    rows = _jobs(spark, d)
    b = rows.groupBy("isco_code").agg(F.avg("exposure_score").alias("m")).agg(F.var_samp("m").alias("b"))
    t = rows.agg(F.var_samp("exposure_score").alias("t"))
    return b.crossJoin(F.broadcast(t)).select(F.round("b", 9).alias("between_groups"), F.round(F.col("t") - F.col("b"), 9).alias("within_groups"))


@q(f"select isco_code, round(avg(exposure_score) + 1e-9, 6) as mean, count(*) as n from {_GOOD} group by 1")
def agg_occ_mean(spark, d):
    return _jobs(spark, d).groupBy("isco_code").agg(F.round(F.avg("exposure_score") + 1e-9, 6).alias("mean"), F.count("*").alias("n"))


@q(f"with y as (select company_id, year, avg(exposure_score) m from {_GOOD} group by 1, 2) select company_id, round(avg(m) + 1e-9, 6) as mean, count(*) as n_years from y group by 1")
def agg_firm_year_mean(spark, d):
    y = _jobs(spark, d).groupBy("company_id", "year").agg(F.avg("exposure_score").alias("m"))
    return y.groupBy("company_id").agg(F.round(F.avg("m") + 1e-9, 6).alias("mean"), F.count("*").alias("n_years"))


@q("select year, count(*) as n, count(distinct company_id) as n_firms, count(distinct title) as n_titles from stage6_jobs_linked__jobads_isco_variant group by 1")
def agg_panel_summary(spark, d):
    return table(spark, d, JOBS).groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("company_id").alias("n_firms"), F.countDistinct("title").alias("n_titles"))


@q(f"with s as (select 'p10' as spec, 0.95 t union all select 'p20', 0.9 union all select 'p50', 0.8) select spec, count(*) as n, round(avg(similarity) + 1e-9, 6) as mean, quantile_cont(similarity, 0.75) as q75 from {_SIM} x join s on similarity >= t group by 1")
def agg_dist_by_pct(spark, d):
    """Each pair once for every specification it satisfies: one pass."""
    s = F.array(*[F.when(F.col("similarity") >= t, F.lit(n)) for n, t in (("p10", 0.95), ("p20", 0.9), ("p50", 0.8))])
    long = _pairs(spark, d).select("similarity", F.explode(F.array_compact(s)).alias("spec"))
    return long.groupBy("spec").agg(F.count("*").alias("n"), F.round(F.avg("similarity") + 1e-9, 6).alias("mean"), F.percentile("similarity", 0.75).alias("q75"))


@q("select (select count(distinct uid) from step1_output) as n_step1, (select count(distinct uid) from step2_output) as n_step2, (select count(distinct uid) from step3_output) as n_step3")
def agg_coverage(spark, d):
    n = lambda k: table(spark, d, f"step{k}_output").agg(F.countDistinct("uid").alias(f"n_step{k}"))
    return n(1).crossJoin(F.broadcast(n(2))).crossJoin(F.broadcast(n(3)))


@q(f"with {_P}, c as (select yr, v - lag(v) over (partition by id order by yr) dv from p) select yr::int as year, count(dv) as n, avg(dv) as mean, coalesce(count_if(dv > 0), 0) as n_gain, coalesce(count_if(dv < 0), 0) as n_loss from c group by 1")
def agg_expertise_trend(spark, d):
    dv = F.col("v") - F.lag("v").over(Window.partitionBy("id").orderBy("year"))
    return _panel(spark, d).withColumn("dv", dv).groupBy("year").agg(F.count("dv").alias("n"), F.avg("dv").alias("mean"), F.count_if(F.col("dv") > 0).alias("n_gain"), F.count_if(F.col("dv") < 0).alias("n_loss"))


@q("select (l_discount > 0.05) as exposed, count(*) as n, avg(l_quantity) as mean, stddev_samp(l_quantity) as sd, median(l_quantity) as median from lineitem group by 1")
def agg_means_by_exposure(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_discount") > 0.05).alias("exposed")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"), F.percentile("l_quantity", 0.5).alias("median"))


@q("with p as (select o_custkey, bool_or(o_orderstatus = 'F') f, bool_or(o_orderstatus = 'O') o, count(*) n from orders group by 1), c as (select case when f and o then 'both' when f then 'f only' when o then 'o only' else 'neither' end class from p) select k as class, count(class) as n from (select unnest(['both','f only','o only','neither']) k) left join c on class = k group by 1")
def agg_mobility(spark, d):
    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"))
    c = p.select(F.when(F.col("f") & F.col("o"), "both").when(F.col("f"), "f only").when(F.col("o"), "o only").otherwise("neither").alias("class")).groupBy("class").agg(F.count("*").alias("m"))
    all_ = spark.createDataFrame([(x,) for x in ("both", "f only", "o only", "neither")], "class string")
    return all_.join(c, "class", "left").select("class", F.coalesce("m", F.lit(0)).alias("n"))


@q(f"select isco_code, year, round(avg(exposure_score) + 1e-9, 6) as mean, stddev_samp(exposure_score) as sd, count(*) as n from {_GOOD} group by 1, 2")
def agg_occ_year_mean(spark, d):
    e = "exposure_score"
    return _jobs(spark, d).groupBy("isco_code", "year").agg(F.round(F.avg(e) + 1e-9, 6).alias("mean"), F.stddev_samp(e).alias("sd"), F.count("*").alias("n"))


@q("select isco_code, year, count(distinct title) as n_titles, count(*) as n_jobs, count(distinct company_id) as n_firms from stage6_jobs_linked__jobads_isco_variant group by 1, 2")
def agg_occ_year_hiring(spark, d):
    return table(spark, d, JOBS).groupBy("isco_code", "year").agg(F.countDistinct("title").alias("n_titles"), F.count("*").alias("n_jobs"), F.countDistinct("company_id").alias("n_firms"))


@q("with p as (select l_partkey, avg(l_discount) a, avg(l_tax) b from lineitem group by 1) select corr(a, b) as r, count(*) as n from p")
def agg_task_fit(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return p.agg(F.corr("a", "b").alias("r"), F.count("*").alias("n"))


@q(f"with {_P}, c as (select id, yr, n - lag(n) over (partition by id order by yr) dn from p) select yr::int as year, coalesce(count_if(dn > 0), 0) as new, coalesce(count_if(dn < 0), 0) as gone from c group by 1")
def agg_version_summary(spark, d):
    dn = F.col("n") - F.lag("n").over(Window.partitionBy("id").orderBy("year"))
    return _panel(spark, d).withColumn("dn", dn).groupBy("year").agg(F.count_if(F.col("dn") > 0).alias("new"), F.count_if(F.col("dn") < 0).alias("gone"))


@q("select company_id, title, min(year) as first_year, arg_min_null(isco_code, (year, link_id)) as isco_code from stage6_jobs_linked__jobads_isco_variant group by 1, 2")
def agg_emerging(spark, d):
    return table(spark, d, JOBS).groupBy("company_id", "title").agg(F.min("year").alias("first_year"), F.min_by("isco_code", F.struct("year", "link_id")).alias("isco_code"))


_DOC = "with g as (select distinct o_custkey k, o_orderpriority i from orders where o_orderkey % 3 <> 0), f as (select distinct o_custkey k, o_orderpriority i from orders where o_orderkey % 3 <> 1), b as (select coalesce(g.k, f.k) k, count_if(g.k is not null and f.k is not null) tp, count_if(g.k is null) fp, count_if(f.k is null) fn from g full join f on g.k = f.k and g.i = f.i group by 1), s as (select k, tp, fp, fn, case when tp + fp > 0 then tp / (tp + fp) else 0 end p, case when tp + fn > 0 then tp / (tp + fn) else 0 end r from b)"


def _docs(spark, d):
    o = table(spark, d, "orders")
    return studies.document_scores(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <> 1"), "o_custkey", "o_orderpriority")


@q(_DOC + " select k as o_custkey, tp, fp, fn, p::double as precision, r::double as recall, case when p + r > 0 then 2 * p * r / (p + r) else 0 end::double as f1 from s")
def agg_doc_prf(spark, d):
    return _docs(spark, d)


@q(_DOC + " select avg(p) as precision, avg(r) as recall, avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end) as f1, count(*) as n from s")
def agg_macro_prf(spark, d):
    return _docs(spark, d).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count("*").alias("n"))


@q(f"with s as (select similarity x, coalesce(cross_encoder_score, 0) > 0.6 g from {_SIM} where cross_encoder_score is null or not isnan(cross_encoder_score)), t as (select unnest([0.70, 0.75, 0.80, 0.85, 0.90, 0.95])::double cut), n as (select cut, count_if(x >= cut and g) tp, count_if(x >= cut and not g) fp, count_if(x < cut and g) fn from s, t group by 1) select cut, (2.0 * tp / nullif(2 * tp + fp + fn, 0))::double as f1 from n order by round(f1, 9) desc, cut limit 1")
def agg_tune_threshold(spark, d):
    rows = _pairs(spark, d).filter(F.col("cross_encoder_score").isNull() | ~F.isnan("cross_encoder_score")).withColumn("gold", F.coalesce("cross_encoder_score", F.lit(0.0)) > 0.6)
    return studies.best_threshold(rows, "similarity", "gold", [0.70, 0.75, 0.80, 0.85, 0.90, 0.95])


@q("select link_id, count(*) over (partition by company_id, title) as n_rows from stage6_jobs_linked__jobads_isco_variant")
def win_transform_min(spark, d):
    return table(spark, d, JOBS).select("link_id", F.count("*").over(Window.partitionBy("company_id", "title")).alias("n_rows"))


@q("with g as (select isco_code, year, count(*) n from stage6_jobs_linked__jobads_isco_variant where isco_code is not null group by 1, 2) select isco_code, year, case when lead(year) over w - year = 1 then ln(lead(n) over w) - ln(n) end as growth from g window w as (partition by isco_code order by year)")
def win_lead_occ(spark, d):
    g = table(spark, d, JOBS).filter("isco_code is not null").groupBy("isco_code", "year").agg(F.count("*").alias("n"))
    return g.select("isco_code", "year", (F.log(panel.lag_if_next("n", "isco_code", "year", -1)) - F.log("n")).alias("growth"))


@q("with g as (select company_id, year, count(*) n from stage6_jobs_linked__jobads_isco_variant where company_id is not null group by 1, 2) select company_id, year, case when year - lag(year) over w = 1 then ln(lag(n) over w) end as lagged from g window w as (partition by company_id order by year)")
def win_lag_firm(spark, d):
    g = table(spark, d, JOBS).filter("company_id is not null").groupBy("company_id", "year").agg(F.count("*").alias("n"))
    return g.select("company_id", "year", F.log(panel.lag_if_next("n", "company_id", "year")).alias("lagged"))


def _top(spark, d, cut, n=10):
    g = _pairs(spark, d).filter(F.col("similarity") >= cut).groupBy("onet_task_id").agg(F.countDistinct("ai_app_id").alias("n"))
    return g.orderBy(F.desc("n"), "onet_task_id").limit(n).agg(F.sort_array(F.collect_list("onet_task_id")).alias("ids"))


@q(f"with a as (select list(t) x from (select onet_task_id t, count(distinct ai_app_id) n from {_SIM} where similarity >= 0.9 group by 1 order by n desc, t limit 10)), b as (select list(t) y from (select onet_task_id t, count(distinct ai_app_id) n from {_SIM} where similarity >= 0.95 group by 1 order by n desc, t limit 10)) select len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) as jaccard from a, b")
def sort_sensitivity_firm(spark, d):
    from tasklattice.functions.vectors import jaccard

    a, b = _top(spark, d, 0.9), _top(spark, d, 0.95).withColumnRenamed("ids", "other")
    return a.crossJoin(F.broadcast(b)).select(jaccard(F.col("ids"), F.col("other")).alias("jaccard"))


@q("with e as (select quantile_cont(exposure_score, 0.25) a, quantile_cont(exposure_score, 0.5) b, quantile_cont(exposure_score, 0.75) c from " + _GOOD + "), x as (select link_id, 1 + (exposure_score > a)::int + (exposure_score > b)::int + (exposure_score > c)::int as bin from " + _GOOD + ", e) select bin, link_id from (select *, row_number() over (partition by bin order by md5(link_id::varchar), link_id) rn from x) where rn <= 5")
def sample_quartile_report(spark, d):
    b = studies.ntile_edges(_jobs(spark, d), "exposure_score", 4)
    return panel.top_per_group(b, ["bin"], [F.md5(F.col("link_id").cast("string").cast("binary")), F.col("link_id")], 5).select("bin", "link_id")


@q()
def dedup_fuzzy_embed(spark, d):
    rows = table(spark, d, "text_vectors").filter("vec is not null")
    return studies.greedy_clusters(rows, "kind", "vec_id", "vec", 0.99)


@q("select distinct uid from step1_output where uid in (select uid from step2_output) and uid not in (select uid from step3_output)")
def set_ledger_pending(spark, d):
    ids = lambda n: table(spark, d, f"step{n}_output").select("uid")
    return ids(1).join(ids(2), "uid", "left_semi").join(ids(3), "uid", "left_anti").distinct()


@q("with f as (select distinct company_id from step1_output), e as (select company_id, count(*) n from step3_output group by 1) select j.company_id, case when e.n is not null then e.n when f.company_id is not null then 0 end as n, case when e.n is not null then 'matched' when f.company_id is not null then 'zero' else 'unknown' end as flag from (select distinct company_id from job_postings_unified where company_id is not null) j left join f on j.company_id = f.company_id left join e on j.company_id = e.company_id")
def null_zero_fill_firm(spark, d):
    j = table(spark, d, "job_postings_unified").filter("company_id is not null").select("company_id").distinct()
    f = table(spark, d, "step1_output").select("company_id").distinct().withColumn("seen", F.lit(True))
    e = table(spark, d, "step3_output").groupBy("company_id").agg(F.count("*").alias("m"))
    flag = F.when(F.col("m").isNotNull(), "matched").when(F.col("seen"), "zero").otherwise("unknown")
    return j.join(f, "company_id", "left").join(e, "company_id", "left").select("company_id", F.when(F.col("m").isNotNull(), F.col("m")).when(F.col("seen"), 0).alias("n"), flag.alias("flag"))


@q("select distinct code from (select unnest(regexp_extract_all(x28_occupations, '[0-9]+')) as code from job_postings_unified) where code not in (select trim(x28_code) from x28_isco_crosswalk where x28_code is not null)")
def quality_accidental(spark, d):
    """Codes of the ads that the crosswalk doesn't know."""
    codes = table(spark, d, "job_postings_unified").select(F.explode(F.regexp_extract_all("x28_occupations", F.lit("([0-9]+)"))).alias("code")).distinct()
    return codes.join(table(spark, d, "x28_isco_crosswalk").select(F.trim("x28_code").alias("code")), "code", "left_anti")


@q("with r as (select onet_task_id, ai_app_id, percent_rank() over (partition by onet_task_id order by similarity desc) p from (select distinct onet_task_id, ai_app_id, similarity from similarity_df where similarity is not null and not isnan(similarity))) select onet_task_id, ai_app_id, p <= 0.05 as pct_5, p <= 0.1 as pct_10, p <= 0.2 as pct_20 from r")
def quality_per_task_flags(spark, d):
    w = Window.partitionBy("onet_task_id").orderBy(F.desc("similarity"))
    r = _pairs(spark, d).select("onet_task_id", "ai_app_id", "similarity").distinct().withColumn("p", F.percent_rank().over(w))
    return r.select("onet_task_id", "ai_app_id", *[(F.col("p") <= x / 100).alias(f"pct_{x}") for x in (5, 10, 20)])


@q("with v as (select kind, trim(text) as text, min_by(vec::double[], vec_id) as vec from text_vectors where vec is not null group by 1, 2), p as (select distinct trim(app_text) as app, trim(onet_task) as task, similarity from similarity_df where similarity is not null and not isnan(similarity)) select task, count(*) as n_compared, count_if(abs(list_cosine_similarity(a.vec, t.vec) - similarity) > 0.001) as n_off from p join v a on a.kind = 'app' and a.text = app join v t on t.kind = 'task' and t.text = task group by 1")
def quality_sim_recompute(spark, d):
    """For each task the stored scores compared with the vectors' cosine, and how
    many differ by more than 0.001."""
    from tasklattice.functions.vectors import cosine

    v = table(spark, d, "text_vectors").filter("vec is not null").groupBy("kind", F.trim("text").alias("text")).agg(F.min_by("vec", "vec_id").alias("vec"))
    a = v.filter("kind = 'app'").select(F.col("text").alias("app"), F.col("vec").alias("va"))
    t = v.filter("kind = 'task'").select(F.col("text").alias("task"), F.col("vec").alias("vt"))
    s = _pairs(spark, d).select(F.trim("app_text").alias("app"), F.trim("onet_task").alias("task"), "similarity").distinct()
    off = F.abs(cosine(F.col("va"), F.col("vt")) - F.col("similarity")) > 1e-3
    return s.join(a, "app").join(t, "task").groupBy("task").agg(F.count("*").alias("n_compared"), F.count_if(off).alias("n_off"))


@q("select count(*) as n, count_if(company_id is null) as n_no_firm, count_if(isco_code is null) as n_no_code, count(*) - count(distinct link_id) as n_repeated from stage6_jobs_linked__jobads_isco_variant")
def quality_panel(spark, d):
    return table(spark, d, JOBS).agg(F.count("*").alias("n"), F.count_if(F.col("company_id").isNull()).alias("n_no_firm"), F.count_if(F.col("isco_code").isNull()).alias("n_no_code"), (F.count("*") - F.countDistinct("link_id")).alias("n_repeated"))


@q("select count(*) as n, count(c.company_id) as n_matched from stage6_jobs_linked__jobads_isco_variant j left join (select distinct company_id from step1_output) c on j.company_id = c.company_id")
def quality_merge_coverage(spark, d):
    c = table(spark, d, "step1_output").select("company_id").distinct().withColumn("hit", F.lit(1))
    return table(spark, d, JOBS).join(c, "company_id", "left").agg(F.count("*").alias("n"), F.count("hit").alias("n_matched"))


@q("select count(*) as n from stage6_jobs_linked__jobads_isco_variant where company_id is not null")
def quality_select_sample(spark, d):
    return table(spark, d, JOBS).filter("company_id is not null").agg(F.count("*").alias("n"))


@q("select (count_if(step2_output is null or trim(step2_output) = '') > 0) as stop, count_if(step2_output is null or trim(step2_output) = '') as n_bad from step2_output")
def quality_pipeline_gate(spark, d):
    bad = F.count_if(F.col("step2_output").isNull() | (F.trim("step2_output") == ""))
    return table(spark, d, "step2_output").agg((bad > 0).alias("stop"), bad.alias("n_bad"))


@q()
def est_grid(spark, d):
    """Two outcomes under two sets of fixed effects."""
    p = _panel(spark, d).withColumn("log_v", F.log1p("v"))
    out = None
    for y in ("v", "log_v"):
        for fixed in (["year"], ["id", "year"]):
            one = _out(spark, E.ols(p, y, ["n"], fixed=fixed, clusters=["id"])).withColumns({"outcome": F.lit(y), "model": F.lit("+".join(fixed))})
            out = one if out is None else out.unionByName(one)
    return out


@q()
def est_did_adoption(spark, d):
    """Event-time coefficients around the first large year, person and year effects."""
    p = _panel(spark, d)
    first = p.filter("v > 4").groupBy("id").agg(F.min("year").alias("g"))
    rows = p.join(first, "id", "left").withColumn("treated", F.col("g").isNotNull()).withColumn("t", F.coalesce(F.col("year") - F.col("g"), F.lit(99)))
    rows, x = studies.event_design(rows, "t", "treated", 3)
    return _out(spark, E.ols(rows, "n", x, fixed=["id", "year"], clusters=["id"]))


@q()
def est_stacked_ld(spark, d):
    """Long differences of one to three years on the cohort's level."""
    p = _panel(spark, d)
    out = None
    for n in (1, 2, 3):
        ld = studies.long_difference(p, "id", "year", "v", n).join(p.select("id", F.col("year").alias("cohort"), "n"), ["id", "cohort"])
        one = _out(spark, E.ols(ld, "change", ["n"], fixed=["cohort"], clusters=["id"])).withColumn("years", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@q()
def est_mediation(spark, d):
    """Total, mediator and direct effect."""
    p = _panel(spark, d).withColumn("m", F.log1p("v"))
    parts = {"total": ("v", ["n"]), "mediator": ("m", ["n"]), "direct": ("v", ["n", "m"])}
    out = None
    for name, (y, x) in parts.items():
        one = _out(spark, E.ols(p, y, x, fixed=["year"], clusters=["id"])).withColumn("step", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@q()
def est_results_table(spark, d):
    """Coefficients with stars, one column for each model."""
    g = est_grid(spark, d)
    cell = F.concat(F.format_number("coef", 4), T.significance(F.col("p")))
    return g.withColumn("cell", cell).groupBy("outcome", "term").pivot("model", ["year", "id+year"]).agg(F.first("cell"))


@q("select p_brand, sum(p_retailprice * p_size) / sum(p_size) as mean from part group by 1")
def udaf_weighted_mean(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(exposure.weighted_mean("p_retailprice", "p_size").alias("mean"))


@q("with b as (select min(year(o_orderdate)) a, max(year(o_orderdate)) z from orders) select unnest(generate_series(a, z))::int as year from b")
def udtf_calendar(spark, d):
    b = table(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("z"))
    return b.select(F.explode(F.sequence("a", "z")).alias("year"))


@q("select uid, sum(length(coalesce(content_clean, '')))::bigint as n_chars, round(sum(length(coalesce(content_clean, ''))) / 4.0 * 0.000002, 8) as cost from (select distinct uid, content_clean from step1_output) group by 1")
def udf_token_cost(spark, d):
    n = F.sum(F.length(F.coalesce("content_clean", F.lit(""))))
    return table(spark, d, "step1_output").select("uid", "content_clean").distinct().groupBy("uid").agg(n.cast("bigint").alias("n_chars"), F.round(n / 4.0 * 0.000002, 8).alias("cost"))


@q()
def udf_llm_split(spark, d):
    r = models.completed(table(spark, d, "step1_output").select("uid", "content_clean").distinct(), "content_clean", models.EchoModel())
    return S.exploded(r.select("uid", "response"), "uid", "response")


@q()
def udf_llm_ensemble(spark, d):
    """Statements that at least three of five runs agree on; each run asks the
    model with its own seed."""
    return models.ensemble(table(spark, d, "step1_output").select("uid", "content_clean").distinct(), "content_clean", models.SeededModel, runs=5, least=3)


