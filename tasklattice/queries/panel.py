"""Windows over panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tasklattice.operators import panel
from tasklattice.queries.registry import Register
from tasklattice.sources.tables import table

q = Register()
QUERIES, SQL = q.queries, q.sql

_YEARS = "p as (select o_custkey id, year(o_orderdate) yr, sum(o_totalprice) v, count(*) n from orders group by 1, 2)"


def _panel(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))


def _pairs(spark, d):
    return table(spark, d, "similarity_df").filter(F.col("similarity").isNotNull() & ~F.isnan("similarity")).select("onet_task_id", "ai_app_id", "similarity").distinct()


@q("select link_id, min(year) over (partition by company_id, title) as start_year from stage6_jobs_linked__jobads_isco_variant")
def win_min_over(spark, d):
    w = Window.partitionBy("company_id", "title")
    return table(spark, d, "stage6_jobs_linked__jobads_isco_variant").select("link_id", F.min("year").over(w).alias("start_year"))


@q(f"with {_YEARS} select id, yr::int as year, round(sum(v) over (partition by id order by yr rows unbounded preceding), 4) as total from p")
def win_cumsum(spark, d):
    return _panel(spark, d).select("id", "year", F.round(panel.running("v", "id", ["year"]), 4).alias("total"))


@q("with e as (select *, sum((event_type = 'login')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) b from events) select event_id, last_value(case when value > 50 then value end ignore nulls) over (partition by user_id, b order by ts, event_id rows between unbounded preceding and current row) as filled from e")
def win_ffill_blocks(spark, d):
    rows = table(spark, d, "events").withColumn("big", F.when(F.col("value") > 50, F.col("value"))).withColumn("o", F.struct("ts", "event_id"))
    return panel.filled_blocks(rows, "user_id", "o", "big", F.col("event_type") == "login").select("event_id", F.col("big_filled").alias("filled"))


@q(f"with {_YEARS} select id, yr::int as year, case when yr - lag(yr) over w = 1 then v - lag(v) over w end as change from p window w as (partition by id order by yr)")
def win_lag_consecutive(spark, d):
    return _panel(spark, d).select("id", "year", panel.difference("v", "id", "year").alias("change"))


@q(f"with {_YEARS}, c as (select id, yr, case when yr - lag(yr) over w = 1 then v - lag(v) over w end dv from p window w as (partition by id order by yr)) select id, yr::int as year, case when yr - lag(yr) over (partition by id order by yr) = 1 then lag(dv) over (partition by id order by yr) end as lagged from c")
def win_lag1(spark, d):
    c = _panel(spark, d).withColumn("dv", panel.difference("v", "id", "year"))
    return c.select("id", "year", panel.lag_if_next("dv", "id", "year").alias("lagged"))


@q(f"with {_YEARS} select id, yr::int as year, case when lead(yr) over w - yr = 1 then lead(v) over w end as next_v from p window w as (partition by id order by yr)")
def win_lead_consecutive(spark, d):
    return _panel(spark, d).select("id", "year", panel.lag_if_next("v", "id", "year", -1).alias("next_v"))


@q(f"with {_YEARS} select id, yr::int as year, case when lead(yr) over w - yr = 1 then (lead(n) over w <> n)::int end as changes from p window w as (partition by id order by yr)")
def win_lead_separation(spark, d):
    nxt = panel.lag_if_next("n", "id", "year", -1)
    return _panel(spark, d).select("id", "year", (nxt != F.col("n")).cast("int").alias("changes"))


@q(f"with {_YEARS} select id, yr::int as year, case when lead(yr) over w - yr = 1 then ln(lead(n) over w) - ln(n) end as growth from p window w as (partition by id order by yr)")
def win_lead_firm(spark, d):
    return _panel(spark, d).select("id", "year", (F.log(panel.lag_if_next("n", "id", "year", -1)) - F.log("n")).alias("growth"))


@q("select onet_task_id, ai_app_id, similarity, percent_rank() over (partition by onet_task_id order by similarity desc) as p from (select distinct onet_task_id, ai_app_id, similarity from similarity_df where similarity is not null and not isnan(similarity))")
def win_percent_rank(spark, d):
    w = Window.partitionBy("onet_task_id").orderBy(F.desc("similarity"))
    return _pairs(spark, d).withColumn("p", F.percent_rank().over(w))


@q("select onet_task_id, ai_app_id, similarity, rank() over (partition by onet_task_id order by similarity desc) + (count(*) over (partition by onet_task_id, similarity) - 1) / 2.0 as r from (select distinct onet_task_id, ai_app_id, similarity from similarity_df where similarity is not null and not isnan(similarity))")
def win_rank_avg(spark, d):
    return _pairs(spark, d).withColumn("r", panel.average_rank("similarity", "onet_task_id"))


@q("select l_orderkey, l_linenumber, round(l_extendedprice - avg(l_extendedprice) over (partition by l_partkey) + 1e-6, 4) as x from lineitem")
def win_demean(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(panel.demeaned("l_extendedprice", "l_partkey") + 1e-6, 4).alias("x"))


@q("with a as (select l_orderkey, l_linenumber, l_suppkey, l_extendedprice - avg(l_extendedprice) over (partition by l_partkey) x from lineitem) select l_orderkey, l_linenumber, round(x - avg(x) over (partition by l_suppkey), 5) as x from a")
def win_demean_seq(spark, d):
    rows = panel.demean_in_turn(table(spark, d, "lineitem"), ["l_extendedprice"], ["l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 5).alias("x"))


@q("select p_partkey, p_size / sum(p_size) over (partition by p_brand) as share from part")
def win_share(spark, d):
    return table(spark, d, "part").select("p_partkey", panel.share("p_size", "p_brand").alias("share"))


@q("select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_partkey) / count(*) over (partition by p_brand) as ecdf from part")
def win_ecdf(spark, d):
    w = Window.partitionBy("p_brand")
    return table(spark, d, "part").select("p_brand", "p_partkey", (F.row_number().over(w.orderBy("p_retailprice", "p_partkey")) / F.count("*").over(w)).alias("ecdf"))


@q(f"with {_YEARS} select yr::int as year, id, rank::int as rank from (select *, row_number() over (partition by yr order by v desc, id) as rank from p) where rank <= 5")
def win_nlargest_per_year(spark, d):
    return panel.top_per_group(_panel(spark, d), ["year"], [F.desc("v"), F.col("id")], 5).select("year", "id", "rank")


@q(f"with {_YEARS}, c as (select id, yr, case when yr - lag(yr) over w = 1 then v - lag(v) over w end dv from p window w as (partition by id order by yr)) select yr::int as year, id, side from (select *, row_number() over (partition by yr order by dv desc, id) a, 'gain' side from c where dv is not null union all select *, row_number() over (partition by yr order by dv, id), 'loss' from c where dv is not null) where a <= 3")
def win_top_per_year_expertise(spark, d):
    c = _panel(spark, d).withColumn("dv", panel.difference("v", "id", "year")).filter("dv is not null")
    side = lambda o, name: panel.top_per_group(c, ["year"], [o, F.col("id")], 3).select("year", "id", F.lit(name).alias("side"))
    return side(F.desc("dv"), "gain").unionByName(side(F.col("dv"), "loss"))


@q(f"with {_YEARS}, c as (select id, yr, v, lag(v) over w pv, yr - lag(yr) over w g from p window w as (partition by id order by yr)) select case when pv > 300000 and v > 300000 then '1to1' when pv > 300000 then '1to0' when v > 300000 then '0to1' else '0to0' end as move, count(*) as n, avg(v - pv) as mean, median(v - pv) as median from c where g = 1 group by 1")
def agg_income_transitions(spark, d):
    c = _panel(spark, d).withColumn("pv", panel.lag_if_next("v", "id", "year")).filter("pv is not null")
    a, b = F.col("pv") > 300000, F.col("v") > 300000
    move = F.when(a & b, "1to1").when(a, "1to0").when(b, "0to1").otherwise("0to0")
    return c.groupBy(move.alias("move")).agg(F.count("*").alias("n"), F.avg(F.col("v") - F.col("pv")).alias("mean"), F.percentile(F.col("v") - F.col("pv"), 0.5).alias("median"))


@q(f"with {_YEARS}, s as (select id, yr, row_number() over (partition by id order by yr) rn, n from (select id, yr, n, lag(n) over (partition by id order by yr) pn from p) where n <> pn) select id, yr::int as switch_year from s where rn = 1")
def join_first_switch(spark, d):
    c = _panel(spark, d).withColumn("pn", F.lag("n").over(Window.partitionBy("id").orderBy("year"))).filter("n <> pn")
    return c.groupBy("id").agg(F.min("year").alias("switch_year"))


@q(f"with {_YEARS} select id, min(yr)::int as adopted from p where v > 300000 group by 1")
def join_first_adoption(spark, d):
    return _panel(spark, d).filter("v > 300000").groupBy("id").agg(F.min("year").alias("adopted"))
