"""Estimates, model adapters and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasklattice.functions import models
from tasklattice.operators import estimators as E
from tasklattice.operators import panel
from tasklattice.queries.registry import Register
from tasklattice.sources.tables import table
from tasklattice.streaming import batches

q = Register()
QUERIES, SQL = q.queries, q.sql


def _panel(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year")).agg((F.sum("o_totalprice") / 1e5).alias("v"), F.count("*").alias("n"))
    return o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "id")


def _out(spark, fit, **more):
    rows = [(t, round(b, 6), None if se != se else round(se, 6), None if p != p else round(p, 6), n) for t, b, se, p, n in fit.rows()]
    return spark.createDataFrame(rows, E.SCHEMA)


_P = "p as (select o_custkey id, year(o_orderdate) yr, sum(o_totalprice) / 1e5 v, count(*) n from orders group by 1, 2)"


@q(f"with {_P} select 'const' as term, round(regr_intercept(v, n), 6) as coef, count(*) as n from p union all select 'n', round(regr_slope(v, n), 6), count(*) from p")
def est_ols_controls(spark, d):
    return _out(spark, E.ols(_panel(spark, d), "v", ["n"])).select("term", "coef", "n")


@q(f"with {_P}, c as (select v - avg(v) over (partition by yr) v, n - avg(n) over (partition by yr) n from p) select 'n' as term, round(sum(v * n) / sum(n * n), 6) as coef, count(*) as n from c")
def est_ols_year(spark, d):
    return _out(spark, E.ols(_panel(spark, d), "v", ["n"], fixed=["year"])).select("term", "coef", "n")


@q(f"with {_P}, c as (select id, v - avg(v) over (partition by id) v, n - avg(n) over (partition by id) n from p), b as (select sum(v * n) / sum(n * n) b from c), s as (select id, sum(n * (v - b * n)) s from c, b group by 1) select 'n' as term, round((select b from b), 6) as coef, round(sqrt(sum(s * s) * count(*) / (count(*) - 1) * ((select count(*) from c) - 1) / ((select count(*) from c) - 1)) / (select sum(n * n) from c), 6) as se from s")
def est_ols_fe_person(spark, d):
    return _out(spark, E.ols(_panel(spark, d), "v", ["n"], fixed=["id"], clusters=["id"])).select("term", "coef", "se")


@q()
def est_first_diff(spark, d):
    """Changes on changes, two-way clusters."""
    p = _panel(spark, d)
    rows = p.withColumn("dv", panel.difference("v", "id", "year")).withColumn("dn", panel.difference("n", "id", "year"))
    return _out(spark, E.ols(rows, "dv", ["dn"], fixed=["year"], clusters=["id", "c_nationkey"]))


@q()
def est_lpm(spark, d):
    rows = _panel(spark, d).withColumn("big", (F.col("v") > 3).cast("double"))
    return _out(spark, E.ols(rows, "big", ["n"], clusters=["c_nationkey"]))


@q()
def est_logit(spark, d):
    rows = _panel(spark, d).withColumn("big", (F.col("v") > 3).cast("double"))
    return _out(spark, E.logit(rows, "big", ["n"], clusters=["c_nationkey"]))


@q()
def est_spec_runner(spark, d):
    """The same outcome under three sets of fixed effects."""
    p = _panel(spark, d)
    specs = {"person": ["id"], "person, year": ["id", "year"], "nation, year": ["c_nationkey", "year"]}
    out = None
    for name, fixed in specs.items():
        one = _out(spark, E.ols(p, "v", ["n"], fixed=fixed, clusters=["id"])).withColumn("spec", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@q()
def est_heterogeneity(spark, d):
    """The same estimate in groups of market segments."""
    p = _panel(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "id")
    out = None
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        one = _out(spark, E.ols(p.filter(F.col("c_mktsegment") == s), "v", ["n"], fixed=["year"], clusters=["id"])).withColumn("segment", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@q("with t as (select n_nationkey k, (n_nationkey + 1) * (n_nationkey + 1) / 700.0::double p from nation), r as (select k, p, row_number() over (order by p, k) i, count(*) over () m from t) select k, p, least(1.0, min(p * m / i) over (order by i desc rows unbounded preceding)) as p_adjusted from r")
def est_fdr_bh(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(k.alias("k"), ((k + 1) * (k + 1) / 700.0).alias("p"))
    return E.benjamini_hochberg(rows, "p", "k")


@q("select l_returnflag, (stddev_samp(l_discount) / sqrt(count(*))) * 2.8 as mde from lineitem group by 1")
def est_power(spark, d):
    from tasklattice.functions.vectors import detectable_effect

    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(detectable_effect(F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("mde"))


@q()
def udf_embed(spark, d):
    """Texts through an embedding adapter (here the deterministic stand-in)."""
    return models.embedded(table(spark, d, "text_vectors").select("vec_id", "text"), "text", models.HashedEmbedder(16)).select("vec_id", F.size("embedding").alias("n_dims"))


@q()
def udf_cross_encoder(spark, d):
    pairs = table(spark, d, "similarity_df").select("app_text", "onet_task").distinct()
    return models.scored(pairs, "app_text", "onet_task", models.OverlapScorer())


@q()
def udf_llm_extract(spark, d):
    rows = table(spark, d, "step1_output").select("uid", "content_clean").distinct()
    return models.completed(rows, "content_clean", models.EchoModel())


@q("select user_id, count(*) as n, sum(value) as total from events group by 1")
def stream_stateful_counts(spark, d):
    return batches.counts(spark, f"{d}/events.parquet")


@q("select count(*) as n from (select distinct event_id from events)")
def stream_ingest_dedup(spark, d):
    return batches.deduplicated(spark, f"{d}/events.parquet").agg(F.count("*").alias("n"))
