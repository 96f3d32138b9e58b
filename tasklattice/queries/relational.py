"""Filters, joins, sets, duplicates, casts and null rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasklattice.functions import text as T
from tasklattice.operators import relational
from tasklattice.plans.skew import join_groups_back
from tasklattice.queries.registry import Register
from tasklattice.sources.tables import table

q = Register()
QUERIES, SQL = q.queries, q.sql

JOBS = "stage6_jobs_linked__jobads_isco_variant"


def _ads(spark, d):
    return table(spark, d, "job_postings_unified")


@q("select o_orderkey, o_custkey from orders where o_custkey in (1,2,3,5,8,13,21)")
def filter_in_list(spark, d):
    return table(spark, d, "orders").filter(F.col("o_custkey").isin(1, 2, 3, 5, 8, 13, 21)).select("o_orderkey", "o_custkey")


@q("select distinct uid, company_id from job_postings_unified where company_id is not null and company_id not in (select company_id from step1_output where company_id is not null)")
def filter_not_in_list(spark, d):
    return relational.not_in_ids(_ads(spark, d), table(spark, d, "step1_output").select("company_id"), "company_id").select("uid", "company_id").distinct()


@q("select link_id, year from stage6_jobs_linked__jobads_isco_variant where year between 2014 and 2020")
def filter_year_range(spark, d):
    return table(spark, d, JOBS).filter(F.col("year").between(2014, 2020)).select("link_id", "year")


@q("select distinct uid from job_postings_unified where content_clean is not null and regexp_matches(content_clean, '\\S')")
def filter_nonempty_trim(spark, d):
    return _ads(spark, d).filter(F.col("content_clean").rlike(r"\S")).select("uid").distinct()


@q("select company_id, count(*) as n from stage6_jobs_linked__jobads_isco_variant where company_id in (select company_id from stage6_jobs_linked__jobads_isco_variant where not isnan(exposure_score) group by company_id having stddev_samp(exposure_score) > 0) group by company_id")
def filter_min_group(spark, d):
    rows = table(spark, d, JOBS)
    keep = rows.filter(~F.isnan("exposure_score")).groupBy("company_id").agg(F.stddev_samp("exposure_score").alias("sd")).filter("sd > 0").select("company_id")
    return rows.join(keep, "company_id", "left_semi").groupBy("company_id").agg(F.count("*").alias("n"))


@q("select l_partkey, count(*) as n from lineitem where l_partkey in (select l_partkey from lineitem group by 1 order by avg(l_extendedprice) desc, l_partkey limit 20) group by 1")
def filter_top_entities(spark, d):
    rows = table(spark, d, "lineitem")
    top = rows.groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("m")).orderBy(F.desc("m"), "l_partkey").limit(20).select("l_partkey")
    return rows.join(top, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"))


@q("select count(*) as n from similarity_df where similarity is not null and not isnan(similarity) and cross_encoder_score is not null and not isnan(cross_encoder_score)")
def filter_complete_case(spark, d):
    cols = ["similarity", "cross_encoder_score"]
    rows = table(spark, d, "similarity_df").dropna(subset=cols)
    return rows.filter(~F.isnan(cols[0]) & ~F.isnan(cols[1])).agg(F.count("*").alias("n"))


@q("select ai_app_id, onet_task_id, similarity from similarity_df where similarity >= 0.9 and cross_encoder_score >= 0.5 and not isnan(similarity) and not isnan(cross_encoder_score)")
def filter_spec_mask(spark, d):
    ok = (F.col("similarity") >= 0.9) & (F.col("cross_encoder_score") >= 0.5) & ~F.isnan("similarity") & ~F.isnan("cross_encoder_score")
    return table(spark, d, "similarity_df").filter(ok).select("ai_app_id", "onet_task_id", "similarity")


@q("select distinct link_id, isco_code from stage6_jobs_linked__jobads_isco_variant where isco_code is null or not starts_with(isco_code, '25')")
def filter_soc15(spark, d):
    c = F.col("isco_code")
    return table(spark, d, JOBS).filter(c.isNull() | ~c.startswith("25")).select("link_id", "isco_code").distinct()


@q("select c_custkey, case when c_acctbal >= 0 then c_acctbal end as at_least_zero, case when c_acctbal > 0 then c_acctbal end as above_zero from customer")
def project_missing_code(spark, d):
    c = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.when(c >= 0, c).alias("at_least_zero"), F.when(c > 0, c).alias("above_zero"))


@q("select o_orderkey, case when o_orderpriority in ('1-URGENT','2-HIGH') then 1 when o_orderpriority in ('4-NOT SPECIFIED','5-LOW') then 0 end as urgent from orders")
def project_binary_recode(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.when(p.isin("1-URGENT", "2-HIGH"), 1).when(p.isin("4-NOT SPECIFIED", "5-LOW"), 0).alias("urgent"))


@q("select c_custkey, ln(1 + greatest(c_acctbal, 0)) as log_balance, c_acctbal - avg(c_acctbal) over () as centred from customer")
def project_outcomes(spark, d):
    rows = table(spark, d, "customer")
    mean = rows.agg(F.avg("c_acctbal").alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).select("c_custkey", F.log1p(F.greatest("c_acctbal", F.lit(0.0))).alias("log_balance"), (F.col("c_acctbal") - F.col("mean")).alias("centred"))


@q("select link_id, concat(coalesce(company_id::varchar,'<NA>'), '_', year::varchar) as firm_year, concat(coalesce(isco_code,'<NA>'), '_', year::varchar) as occ_year from stage6_jobs_linked__jobads_isco_variant")
def project_fe_keys(spark, d):
    key = lambda c: F.concat_ws("_", F.coalesce(F.col(c).cast("string"), F.lit("<NA>")), "year")
    return table(spark, d, JOBS).select("link_id", key("company_id").alias("firm_year"), key("isco_code").alias("occ_year"))


@q("select c_custkey, (c_custkey + 13) * 13 as firm_id, ((c_custkey + 13) * 13) // 13 - 13 as back from customer")
def project_firm_id(spark, d):
    firm = (F.col("c_custkey") + 13) * 13
    return table(spark, d, "customer").select("c_custkey", firm.alias("firm_id"), (F.expr("((c_custkey + 13) * 13) div 13") - 13).alias("back"))


@q("select distinct isco_19, (isco_19::int // 10)::int as isco3, (isco_19::int // 100)::int as isco2 from (select trim(isco_19) isco_19 from x28_isco_crosswalk)")
def project_isco_rollup_key(spark, d):
    c = F.trim("isco_19")
    n = c.cast("int")
    return table(spark, d, "x28_isco_crosswalk").select(c.alias("isco_19"), F.floor(n / 10).cast("int").alias("isco3"), F.floor(n / 100).cast("int").alias("isco2")).distinct()


@q("select o_custkey, count(*) as n, ln(1 + count(*)) * avg(o_totalprice) as adjusted from orders group by 1")
def project_log_intensity(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.log1p(F.count("*")) * F.avg("o_totalprice")).alias("adjusted"))


@q("with e as (select quantile_cont(l_extendedprice, 1/3) a, quantile_cont(l_extendedprice, 2/3) b from lineitem) select l_orderkey, l_linenumber, (l_extendedprice > a and l_extendedprice <= b)::int as t2, (l_extendedprice > b)::int as t3 from lineitem, e")
def project_tercile_dummies(spark, d):
    rows = table(spark, d, "lineitem")
    e = rows.agg(F.percentile("l_extendedprice", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"))
    x, a, b = F.col("l_extendedprice"), F.col("e")[0], F.col("e")[1]
    return rows.crossJoin(F.broadcast(e)).select("l_orderkey", "l_linenumber", ((x > a) & (x <= b)).cast("int").alias("t2"), (x > b).cast("int").alias("t3"))


@q("with m as (select avg(l_discount) md from lineitem) select l_orderkey, l_linenumber, l_quantity * (l_discount - md) as interaction from lineitem, m")
def project_interaction(spark, d):
    rows = table(spark, d, "lineitem")
    m = rows.agg(F.avg("l_discount").alias("md"))
    return rows.crossJoin(F.broadcast(m)).select("l_orderkey", "l_linenumber", (F.col("l_quantity") * (F.col("l_discount") - F.col("md"))).alias("interaction"))


@q("select distinct uid, duplicate_group as group_id from job_postings_unified where regexp_matches(lower(duplicate_group), '^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$')")
def cast_uuid_validated(spark, d):
    return _ads(spark, d).select("uid", T.uuid_or_null(F.col("duplicate_group")).alias("group_id")).filter("group_id is not null").distinct()


@q("select distinct uid, case when year(tst_created) between 2000 and 2030 then year(tst_created)::int end as year from job_postings_unified")
def cast_year_prefix(spark, d):
    return _ads(spark, d).select("uid", T.year_prefix(F.col("tst_created").cast("string")).alias("year")).distinct()


@q("select event_id, try_cast(props->>'k' as int) as k from events")
def cast_nullable_int(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@q("select link_id, try_cast(regexp_replace(isco_code, '\\.0$', '') as int) as code from stage6_jobs_linked__jobads_isco_variant where regexp_matches(isco_code, '^[0-9]{4}(\\.0)?$')")
def cast_code(spark, d):
    return table(spark, d, JOBS).filter(F.col("isco_code").rlike(r"^[0-9]{4}(\.0)?$")).select("link_id", F.regexp_replace("isco_code", r"\.0$", "").try_cast("int").alias("code"))


@q("select j.link_id, j.company_id, j.year, c.c_name from stage6_jobs_linked__jobads_isco_variant j join customer c on j.link_id = c.c_custkey")
def join_inner_keys(spark, d):
    return table(spark, d, JOBS).join(table(spark, d, "customer").withColumnRenamed("c_custkey", "link_id"), "link_id").select("link_id", "company_id", "year", "c_name")


@q("select distinct company_id from job_postings_unified j where company_id is not null and not exists (select 1 from step1_output s where s.company_id = j.company_id)")
def join_anti_left(spark, d):
    """Firms of the ads that no linked row has."""
    return _ads(spark, d).filter("company_id is not null").select("company_id").distinct().join(table(spark, d, "step1_output").select("company_id"), "company_id", "left_anti")


@q("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_shipdate < timestamp '1996-01-01')")
def join_anti_right(spark, d):
    early = table(spark, d, "lineitem").filter(F.col("l_shipdate") < "1996-01-01")
    return table(spark, d, "part").join(early, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@q("select distinct o_orderkey, l_suppkey from orders join (select * from lineitem where l_quantity > 45) on o_orderkey = l_orderkey")
def join_semi_seed(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity > 45")
    return table(spark, d, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_suppkey").distinct()


@q("with w as (select distinct trim(x28_code) code, trim(isco_19) isco from x28_isco_crosswalk), j as (select distinct uid, unnest(regexp_extract_all(x28_occupations, '[0-9]{6,}')) code from job_postings_unified) select distinct uid, isco as isco_code from j join w using (code)")
def join_crosswalk_1n(spark, d):
    walk = table(spark, d, "x28_isco_crosswalk").select(F.trim("x28_code").alias("code"), F.trim("isco_19").alias("isco_code"))
    jobs = _ads(spark, d).select("uid", F.explode(F.regexp_extract_all("x28_occupations", F.lit(r"([0-9]{6,})"))).alias("code")).distinct()
    return relational.crosswalk(jobs, walk, "code", "isco_code").select("uid", "isco_code").distinct()


@q("select distinct trim(isco_19) as isco_code, first_value(trim(x28_code)) over (partition by trim(isco_19) order by trim(x28_code)) as x28_code from x28_isco_crosswalk")
def join_crosswalk_first(spark, d):
    walk = table(spark, d, "x28_isco_crosswalk").select(F.trim("isco_19").alias("isco_code"), F.trim("x28_code").alias("x28_code"))
    return relational.first_by(walk, ["isco_code"], [F.col("x28_code")])


@q("select o_orderkey, o_custkey, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def join_m1_validated(spark, d):
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return relational.left_checked(table(spark, d, "orders"), right, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment")


@q("select a.uid, b.step2_output from (select distinct uid from step1_output) a left join (select distinct uid, step2_output from step2_output) b on a.uid = b.uid")
def join_composite_left(spark, d):
    return table(spark, d, "step1_output").select("uid").distinct().join(table(spark, d, "step2_output").select("uid", "step2_output").distinct(), "uid", "left")


@q("with n as (select distinct company_name, company_id from job_postings_unified where company_name is not null and company_id is not null), k as (select company_name, count(*) as n_ids from n group by 1) select s.link_id, n.company_id as found_id, coalesce(k.n_ids, 0) as n_ids from stage6_jobs_linked__jobads_isco_variant s left join n on s.company_name = n.company_name left join k on s.company_name = k.company_name")
def join_name_to_id(spark, d):
    """Ids by name; a name with several ids gives a row for each."""
    names = _ads(spark, d).filter("company_name is not null and company_id is not null").select("company_name", F.col("company_id").alias("found_id")).distinct()
    sizes = names.groupBy("company_name").agg(F.count("*").alias("n_ids"))
    return table(spark, d, JOBS).select("link_id", "company_name").join(names, "company_name", "left").join(sizes, "company_name", "left").select("link_id", "found_id", F.coalesce("n_ids", F.lit(0)).alias("n_ids"))


@q("select n_name, y::int as year from nation, (select distinct year(o_orderdate) y from orders)")
def join_cross_years(spark, d):
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return table(spark, d, "nation").select("n_name").crossJoin(F.broadcast(years))


@q("with f as (select o_custkey firm, l_suppkey app, min(year(o_orderdate)) fy from orders join lineitem on o_orderkey = l_orderkey group by 1, 2), y as (select distinct o_custkey firm, year(o_orderdate) as year from orders) select f.firm, y.year::int as year, count(*) as n_apps from f join y on f.firm = y.firm and f.fy <= y.year group by 1, 2")
def join_range_first_year(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    first = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("firm"), "l_suppkey").agg(F.min(F.year("o_orderdate")).alias("first_year"))
    years = o.select(F.col("o_custkey").alias("firm"), F.year("o_orderdate").alias("year")).distinct()
    return relational.available_by_year(first, years, "firm").groupBy("firm", "year").agg(F.count("*").alias("n_apps"))


@q("with s as (select company_id, title, min(year) sy from stage6_jobs_linked__jobads_isco_variant group by 1, 2) select company_id, title, unnest(generate_series(sy, greatest(2025, sy)))::int as year from s")
def join_calendar_expand(spark, d):
    start = table(spark, d, JOBS).groupBy("company_id", "title").agg(F.min("year").alias("start"))
    return relational.calendar(start, "start", 2025).select("company_id", "title", "year")


@q("with a as (select company_id, count(*) n1 from step1_output group by 1), b as (select company_id, count(*) n2 from step2_output group by 1) select coalesce(a.company_id, b.company_id) as company_id, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2 from a full join b on a.company_id = b.company_id")
def join_outer_specs(spark, d):
    one = lambda n: table(spark, d, f"step{n}_output").groupBy("company_id").agg(F.count("*").alias(f"n{n}"))
    a, b = one(1), one(2)
    j = a.join(b, a.company_id == b.company_id, "full")
    return j.select(F.coalesce(a.company_id, b.company_id).alias("company_id"), F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2"))


@q("with a as (select s_nationkey, avg(s_acctbal) v from supplier group by 1), r as (select n_regionkey, avg(s_acctbal) v from supplier join nation on s_nationkey = n_nationkey group by 1) select c_custkey, coalesce(a.v, r.v) as value, case when a.v is not null then 'nation' when r.v is not null then 'region' else 'none' end as match_level from customer join nation on c_nationkey = n_nationkey left join a on a.s_nationkey = c_nationkey left join r on r.n_regionkey = nation.n_regionkey")
def join_fallback(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    near = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("value"))
    far = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.avg("s_acctbal").alias("value"))
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return relational.fallback(rows, [("nation", near, ["n_nationkey"]), ("region", far, ["n_regionkey"])], "value").select("c_custkey", "value", "match_level")


@q("with m as (select isco_code, year, avg(exposure_score) m from stage6_jobs_linked__jobads_isco_variant where not isnan(exposure_score) group by 1, 2) select link_id, m as occ_year_mean, exposure_score - m as deviation from stage6_jobs_linked__jobads_isco_variant j left join m on j.isco_code = m.isco_code and j.year = m.year")
def join_decompose(spark, d):
    rows = table(spark, d, JOBS)
    means = rows.filter(~F.isnan("exposure_score")).groupBy("isco_code", "year").agg(F.avg("exposure_score").alias("occ_year_mean"))
    return rows.join(means, ["isco_code", "year"], "left").select("link_id", "occ_year_mean", (F.col("exposure_score") - F.col("occ_year_mean")).alias("deviation"))


@q("with o as (select o_custkey id, year(o_orderdate) y, sum(o_totalprice) v from orders group by 1, 2) select a.id, a.y::int as year, b.v - c.v as change from o a join o b on a.id = b.id and b.y = a.y + 1 join o c on a.id = c.id and c.y = a.y - 1")
def join_self_prev_post(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    post, prev = o.select("id", (F.col("year") - 1).alias("year"), F.col("v").alias("post")), o.select("id", (F.col("year") + 1).alias("year"), F.col("v").alias("prev"))
    return o.join(post, ["id", "year"]).join(prev, ["id", "year"]).select("id", "year", (F.col("post") - F.col("prev")).alias("change"))


@q("with f as (select o_custkey, min(year(o_orderdate)) g from orders where o_totalprice > 300000 group by 1) select o_orderkey, (year(o_orderdate) - g)::int as event_time from orders join f using (o_custkey) where year(o_orderdate) - g between -5 and 5")
def join_event_cohort(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    first = o.filter("o_totalprice > 300000").groupBy("o_custkey").agg(F.min("year").alias("g"))
    t = F.col("year") - F.col("g")
    return o.join(first, "o_custkey").filter(t.between(-5, 5)).select("o_orderkey", t.cast("int").alias("event_time"))


@q("with a as (select vec_id, vec::double[] v from text_vectors where kind = 'app' and vec is not null and list_inner_product(vec::double[], vec::double[]) > 0), t as (select vec_id, vec::double[] v from text_vectors where kind = 'task' and vec is not null and list_inner_product(vec::double[], vec::double[]) > 0) select a.vec_id as a, t.vec_id as b from a, t where list_cosine_similarity(a.v, t.v) >= 0.9")
def join_sim_range(spark, d):
    """Pairs of application and task vectors of at least this cosine."""
    from tasklattice.operators.similarity import pairs_above

    v = table(spark, d, "text_vectors")
    return pairs_above(v.filter("kind = 'app'"), v.filter("kind = 'task'"), 0.9)


@q("with a as (select vec_id, vec::double[] v from text_vectors where kind = 'app' and vec is not null and list_inner_product(vec::double[], vec::double[]) > 0), t as (select vec_id, vec::double[] v from text_vectors where kind = 'task' and vec is not null and list_inner_product(vec::double[], vec::double[]) > 0), p as (select t.vec_id task_id, a.vec_id app_id, list_cosine_similarity(a.v, t.v) c from a, t) select task_id, app_id, rank::int as rank from (select *, row_number() over (partition by task_id order by c desc, app_id) rank from p) where rank <= 10")
def join_sim_topk(spark, d):
    from tasklattice.operators.similarity import best_for_each

    v = table(spark, d, "text_vectors")
    return best_for_each(v.filter("kind = 'task'"), v.filter("kind = 'app'"), 10).select(F.col("query").alias("task_id"), F.col("item").alias("app_id"), "rank")


@q(f"select distinct uid, row_number() over (partition by md5(trim(regexp_replace(lower(content_clean), '{T.SPACE}+', ' ', 'g'))) order by tst_created, uid) = 1 as kept from (select distinct uid, content_clean, tst_created from job_postings_unified where content_clean is not null)")
def dedup_exact_hash(spark, d):
    """The first ad of each text is kept. Texts are hashed where they are read; a
    text that many ads have is counted before it is joined back to them."""
    rows = _ads(spark, d).filter("content_clean is not null").select("uid", "tst_created", T.md5_content(F.col("content_clean")).alias("h")).distinct()
    first = rows.groupBy("h").agg(F.min(F.struct("tst_created", "uid")).getField("uid").alias("first_uid"), F.count("*").alias("n"))
    return join_groups_back(rows, first, ["h"], "n").select("uid", (F.col("uid") == F.col("first_uid")).alias("kept"))


@q("select company_id, title, min(uid) as uid from (select distinct uid, company_id, title, content_clean, first_value(uid) over (partition by company_id, title, content_clean order by tst_created, uid) f from job_postings_unified) where uid = f group by 1, 2")
def dedup_exact_keys(spark, d):
    rows = relational.first_by(_ads(spark, d), ["company_id", "title", "content_clean"], [F.col("tst_created"), F.col("uid")])
    return rows.groupBy("company_id", "title").agg(F.min("uid").alias("uid"))


@q("with s as (select company_id, title, min(year) sy from stage6_jobs_linked__jobads_isco_variant group by 1, 2), e as (select company_id, title, unnest(generate_series(sy, greatest(sy, 2025))) y from s) select company_id, y::int as year, count(*) as n_titles from e group by 1, 2")
def dedup_jobs_extend(spark, d):
    start = table(spark, d, JOBS).groupBy("company_id", "title").agg(F.min("year").alias("start"))
    return relational.calendar(start, "start", 2025).groupBy("company_id", "year").agg(F.count("*").alias("n_titles"))


@q("select distinct company_id, year, isco_code from stage6_jobs_linked__jobads_isco_variant")
def dedup_drop_keys(spark, d):
    return table(spark, d, JOBS).select("company_id", "year", "isco_code").distinct()


@q("select app_text, onet_task_id, max(similarity) as similarity from similarity_df where not isnan(similarity) group by 1, 2")
def dedup_pair_scores(spark, d):
    return table(spark, d, "similarity_df").filter(~F.isnan("similarity")).groupBy("app_text", "onet_task_id").agg(F.max("similarity").alias("similarity"))


@q("select distinct uid from (select uid::varchar uid from step1_output union all select uid::varchar from step2_output union all select uid::varchar from step3_output)")
def set_union_all(spark, d):
    parts = [table(spark, d, f"step{n}_output").select(F.col("uid").cast("string").alias("uid")) for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@q("select uid, min(src)::int as src from (select uid, 0 src from step3_output union all select uid, 1 from step2_output union all select uid, 2 from step1_output) group by 1")
def set_union_priority(spark, d):
    parts = [table(spark, d, f"step{n}_output").select("uid") for n in (3, 2, 1)]
    return relational.union_by_priority(parts, "uid")


@q("select distinct uid from step1_output except select distinct uid from step2_output")
def set_except(spark, d):
    return table(spark, d, "step1_output").select("uid").join(table(spark, d, "step2_output").select("uid"), "uid", "left_anti").distinct()


@q("select distinct uid from step1_output intersect select distinct uid from step3_output")
def set_intersect(spark, d):
    return table(spark, d, "step1_output").select("uid").intersect(table(spark, d, "step3_output").select("uid"))


@q("select uid, 1 as origin from (select distinct uid from step1_output) where uid not in (select uid from step3_output) union all select distinct uid, 3 from step3_output")
def set_upsert_rows(spark, d):
    old = table(spark, d, "step1_output").select("uid").distinct().withColumn("origin", F.lit(1))
    new = table(spark, d, "step3_output").select("uid").distinct().withColumn("origin", F.lit(3))
    return relational.replace_rows(old, new, "uid")


@q("with l as (select distinct uid, 2 attempts, 'failed' status from step1_output), f as (select distinct uid from step2_output), r as (select distinct uid from step3_output) select coalesce(l.uid, f.uid) as uid, (coalesce(attempts,0) + (f.uid is not null)::int)::int as attempts, case when coalesce(attempts,0) + (f.uid is not null)::int >= 3 then 'needs_manual' when f.uid is not null then 'failed' else coalesce(status,'pending') end as status from l full join f on l.uid = f.uid where coalesce(l.uid, f.uid) not in (select uid from r)")
def set_ledger_merge(spark, d):
    ids = lambda n: table(spark, d, f"step{n}_output").select("uid").distinct()
    return relational.merge_ledger(ids(1).withColumns({"attempts": F.lit(2), "status": F.lit("failed")}), ids(2), ids(3))


@q("select c_custkey, case when n is null and c_mktsegment <> 'BUILDING' then 0 else n end as n_orders from customer left join (select o_custkey, count(*) n from orders where o_totalprice > 400000 group by 1) on c_custkey = o_custkey")
def null_zero_fill_level(spark, d):
    n = table(spark, d, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    gate = F.col("n").isNull() & (F.col("c_mktsegment") != "BUILDING")
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.when(gate, F.lit(0)).otherwise(F.col("n")).alias("n_orders"))


@q("select company_id, coalesce(sum((isco_code like '25%')::int) / nullif(count(isco_code), 0), 0)::double as share from stage6_jobs_linked__jobads_isco_variant group by 1")
def null_inf_to_zero(spark, d):
    hit = F.coalesce(F.sum(F.col("isco_code").startswith("25").cast("int")), F.lit(0))
    return table(spark, d, JOBS).groupBy("company_id").agg(F.coalesce(F.try_divide(hit.cast("double"), F.count("isco_code")), F.lit(0.0)).alias("share"))


@q("select count(*) as n_rows, count_if(x28_occupations is null or x28_occupations = '[]') as n_empty, count(*) - count(distinct uid) as n_repeated from job_postings_unified")
def quality_validate_jobs(spark, d):
    empty = F.col("x28_occupations").isNull() | (F.col("x28_occupations") == "[]")
    return _ads(spark, d).agg(F.count("*").alias("n_rows"), F.count_if(empty).alias("n_empty"), (F.count("*") - F.countDistinct("uid")).alias("n_repeated"))


@q("select uid, case when uid not in (select uid from step2_output) then 'lost_in_step2' else 'lost_in_step3' end as reason from (select distinct uid from step1_output where uid not in (select uid from step3_output))")
def quality_uid_loss(spark, d):
    ids = lambda n: table(spark, d, f"step{n}_output").select("uid").distinct()
    lost = ids(1).join(ids(3), "uid", "left_anti").join(ids(2).withColumn("in2", F.lit(True)), "uid", "left")
    return lost.select("uid", F.when(F.col("in2").isNull(), "lost_in_step2").otherwise("lost_in_step3").alias("reason"))


@q("select ai_app_id, app_text from similarity_df where ai_app_id <> upper(md5(app_text))")
def quality_app_alignment(spark, d):
    return table(spark, d, "similarity_df").filter(F.col("ai_app_id") != T.app_id(F.col("app_text"))).select("ai_app_id", "app_text")


@q("select onet_task_id, count(distinct onet_task) as n_texts, count(distinct trim(onet_task)) = 1 as aligned from similarity_df group by 1")
def quality_task_alignment(spark, d):
    """Whether each task id stands for one text, blanks at the ends aside."""
    return table(spark, d, "similarity_df").groupBy("onet_task_id").agg(F.countDistinct("onet_task").alias("n_texts"), (F.countDistinct(F.trim("onet_task")) == 1).alias("aligned"))


@q("select company_id, year, title, count(*) as n from stage6_jobs_linked__jobads_isco_variant group by 1, 2, 3 having count(*) > 1")
def quality_unique_keys(spark, d):
    return table(spark, d, JOBS).groupBy("company_id", "year", "title").agg(F.count("*").alias("n")).filter("n > 1")


@q("with r as (select onet_task_id, ai_app_id, percent_rank() over (partition by onet_task_id order by similarity desc) p from (select distinct onet_task_id, ai_app_id, similarity from similarity_df where not isnan(similarity))) select onet_task_id, ai_app_id from r where p <= 0.2")
def quality_per_task_filter(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "similarity_df").filter(~F.isnan("similarity")).select("onet_task_id", "ai_app_id", "similarity").distinct()
    w = Window.partitionBy("onet_task_id").orderBy(F.desc("similarity"))
    return rows.withColumn("p", F.percent_rank().over(w)).filter("p <= 0.2").select("onet_task_id", "ai_app_id")


@q("with r as (select percent_rank() over (partition by onet_task_id order by similarity desc) p from (select distinct onet_task_id, ai_app_id, similarity from similarity_df where not isnan(similarity))) select count_if(p <= 0.05 and not p <= 0.1) + count_if(p <= 0.1 and not p <= 0.2) as violations from r")
def quality_monotone(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "similarity_df").filter(~F.isnan("similarity")).select("onet_task_id", "ai_app_id", "similarity").distinct()
    p = F.percent_rank().over(Window.partitionBy("onet_task_id").orderBy(F.desc("similarity")))
    r = rows.select(p.alias("p"))
    return r.agg((F.count_if((F.col("p") <= 0.05) & ~(F.col("p") <= 0.1)) + F.count_if((F.col("p") <= 0.1) & ~(F.col("p") <= 0.2))).alias("violations"))


@q("select count(*) as n, count_if(n > 1) as n_not_bijective from (select c_custkey, count(distinct (c_custkey + 13) * 13) n from customer group by 1)")
def quality_bijective(spark, d):
    n = table(spark, d, "customer").groupBy("c_custkey").agg(F.countDistinct((F.col("c_custkey") + 13) * 13).alias("n"))
    return n.agg(F.count("*").alias("n"), F.count_if(F.col("n") > 1).alias("n_not_bijective"))


@q("select ai_app_id, array_to_string(list_sort(list_distinct(flatten(list(job_uid)))), '|') as job_uids from similarity_df where job_uid is not null group by 1")
def agg_job_app_map(spark, d):
    rows = table(spark, d, "similarity_df").select("ai_app_id", F.explode("job_uid").alias("u")).distinct()
    return rows.groupBy("ai_app_id").agg(F.array_join(F.sort_array(F.collect_set("u")), "|").alias("job_uids"))


@q("select u as job_uid, list_sort(list(distinct ai_app_id)) as app_ids from (select unnest(job_uid) u, ai_app_id from similarity_df) group by 1")
def agg_app_ids_per_job(spark, d):
    return table(spark, d, "similarity_df").select(F.explode("job_uid").alias("job_uid"), "ai_app_id").groupBy("job_uid").agg(F.sort_array(F.collect_set("ai_app_id")).alias("app_ids"))

