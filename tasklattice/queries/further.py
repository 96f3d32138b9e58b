"""Further operators: chunked and dispatched exposure, response repair and votes,
sinks that are read back, renamed columns, rankings and resumed runs."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tasklattice.functions import models
from tasklattice.functions import structured as S
from tasklattice.functions import text as T
from tasklattice.operators import exposure
from tasklattice.plans.lineage import shared_dir
from tasklattice.queries.aggregates import _GOOD, _MATCH, _jobs, _matches
from tasklattice.queries.estimators import _panel
from tasklattice.queries.registry import Register
from tasklattice.sources import files
from tasklattice.sources.tables import table
from tasklattice.streaming import batches

q = Register()
QUERIES, SQL = q.queries, q.sql

JOBS = "stage6_jobs_linked__jobads_isco_variant"
_P = "p as (select o_custkey id, year(o_orderdate) yr, sum(o_totalprice) / 1e5 v, count(*) n from orders group by 1, 2)"


def _place(spark):
    return f"{shared_dir(spark)}/exchange-{uuid.uuid4().hex}"


# Exposure -----------------------------------------------------------------

_PAIRS = f"m as (select distinct company_id firm, title app, isco_code task, year yr from {JOBS} where company_id is not null and title is not null and isco_code is not null)"
_AVAILABLE = f"{_PAIRS}, f as (select firm, app, min(yr) fy from m group by 1, 2), y as (select distinct yr from m), av as (select f.firm, f.app, y.yr from f join y on f.fy <= y.yr), na as (select firm, yr, count(*) n_apps from av group by 1, 2), g as (select distinct app, task from m)"
_FIRM = "select 'firm' as mode, av.firm, av.yr, g.task, count(*) as n_matched, max(n_apps) as n_apps from av join g on av.app = g.app join na on av.firm = na.firm and av.yr = na.yr group by 2, 3, 4"
_OWN = "select 'own' as mode, av.firm, av.yr, o.task, count(*) as n_matched, max(n_apps) as n_apps from av join (select distinct firm, app, task from m) o on av.firm = o.firm and av.app = o.app join na on av.firm = na.firm and av.yr = na.yr group by 2, 3, 4"
_PURE = "select 'pure' as mode, null::bigint as firm, ga.yr, g.task, count(*) as n_matched, max(n) as n_apps from (select fa.app, y.yr, count(*) over (partition by y.yr) n from (select app, min(yr) fy from m group by 1) fa join y on fa.fy <= y.yr) ga join g on ga.app = g.app group by 2, 3, 4"


def _job_matches(spark, d):
    return table(spark, d, JOBS).select(F.col("company_id").alias("firm"), F.col("title").alias("app"), F.col("isco_code").alias("task"), "year").dropna().distinct()


def _columns(df, mode):
    return df.select(F.lit(mode).alias("mode"), F.col("firm").cast("bigint").alias("firm"), F.col("year").alias("yr"), "task", "n_matched", "n_apps")


@q(f"with m as {_MATCH} select firm, task, count(distinct app) as n_matched from m group by 1, 2")
def agg_firm_task_chunked(spark, d):
    """Counts of each chunk of apps, added up; the years are those of all chunks."""
    m = _matches(spark, d).select("firm", "app", "task").distinct()
    partial = m.groupBy("firm", "task", F.pmod(F.xxhash64("app"), F.lit(8)).alias("chunk")).agg(F.count("*").alias("n"))
    return partial.groupBy("firm", "task").agg(F.sum("n").alias("n_matched"))


@q(f"with {_AVAILABLE} {_FIRM}")
def agg_occ_expand_firm(spark, d):
    """Shares by a firm's own portfolio, whose apps match what they match anywhere."""
    m = _job_matches(spark, d)
    return _columns(exposure.firm_task_share(m, m.select("year").distinct(), pairs=m.select("app", "task").distinct()), "firm")


@q(f"with {_AVAILABLE} {_FIRM} union all {_OWN} union all {_PURE}")
def agg_occ_dispatch(spark, d):
    """The three forms of the table, by mode."""
    m = _job_matches(spark, d)
    years = m.select("year").distinct()
    own = _columns(exposure.firm_task_share(m, years), "own")
    one = m.withColumn("firm", F.lit(0))
    pure = _columns(exposure.firm_task_share(one, years).withColumn("firm", F.lit(None).cast("bigint")), "pure")
    return agg_occ_expand_firm(spark, d).unionByName(own).unionByName(pure)


# Responses ----------------------------------------------------------------


@q("with l as (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)))) as line from documents), k as (select doc_id, regexp_replace(line, '^[•\\-*0-9. ]+', '') as item from l where regexp_matches(line, '^[•*\\-]') or (length(line) > 3 and regexp_matches(line, '^[0-9]\\. '))) select doc_id, item, count(*) as n from k where length(item) > 10 group by 1, 2")
def json_bullets(spark, d):
    """Bulleted and numbered lines of more than ten characters, where no list can
    be read."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", ""))
    bullet = F.col("line").rlike(r"^[•*\-]") | (F.length("line") > 3) & F.col("line").rlike(r"^[0-9]\. ")
    kept = lines.filter(bullet).select("doc_id", F.regexp_replace("line", r"^[•\-*0-9. ]+", "").alias("item"))
    return kept.filter(F.length("item") > 10).groupBy("doc_id", "item").agg(F.count("*").alias("n"))


@q()
def json_truncate(spark, d):
    """Responses cut after their last complete object where braces stay open."""

    @F.pandas_udf("string")
    def cut_off(texts: pd.Series) -> pd.Series:
        return pd.Series([S.truncated(t) if isinstance(t, str) else None for t in texts], dtype=object)

    return table(spark, d, "step2_output").select("uid", F.col("step2_output").alias("response")).distinct().select("uid", cut_off("response").alias("response"))


@q()
def agg_majority_semantic(spark, d):
    """Statements of five runs, grouped by the likeness of their vectors; groups of
    three or more give their most frequent member."""
    rows = table(spark, d, "step1_output").select("uid", "content_clean").distinct()
    return models.semantic_majority(rows, "content_clean", models.SeededModel, models.HashedEmbedder(64))


_LINES = f"list_filter(list_transform(string_split(coalesce(step2_output, ''), chr(10)), lambda x: regexp_replace(x, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')), lambda x: x <> '' and upper(x) <> 'N/A')"


@q(f"select distinct uid, array_to_string({_LINES}, chr(10)) as kept, len({_LINES})::int as n_lines from step2_output")
def text_join_lines(spark, d):
    """Lines that say something, joined again, and their number."""
    trimmed = F.transform(F.split(F.coalesce("step2_output", F.lit("")), "\n"), lambda x: F.regexp_replace(x, f"^{T.SPACE}+|{T.SPACE}+$", ""))
    lines = F.filter(trimmed, lambda x: (x != "") & (F.upper(x) != "N/A"))
    return table(spark, d, "step2_output").select("uid", F.array_join(lines, "\n").alias("kept"), F.size(lines).alias("n_lines")).distinct()


@q()
def udf_llm_custom(spark, d):
    """A file of texts through all three steps: extracted, kept if readable, joined."""
    rows = table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    got = models.completed(rows, "text", models.EchoModel(), "doc_id").filter(S.malformed(F.col("response")).isNull())
    items = F.from_json("response", "array<string>")
    return got.select("doc_id", F.array_join(items, "\n").alias("joined"), F.size(items).alias("n_items"))


# Text ---------------------------------------------------------------------


@q("select distinct lower(title_en) as term, case when contains(title_en, '.') then 'dotted' when regexp_matches(title_en, '[\\s\\-]') then 'phrase' when length(title_en) <= 5 then 'short' else 'long' end as kind from occupation_reference where title_en is not null")
def text_pattern_classes(spark, d):
    """How each title would be searched as a keyword."""
    terms = [r[0] for r in table(spark, d, "occupation_reference").select(F.lower("title_en")).filter("title_en is not null").distinct().collect()]
    return spark.createDataFrame([(t, k) for k, ts in T.pattern_classes(terms).items() for t in ts], "term string, kind string")


_STOPS = {k: " + ".join(f"contains(' ' || lower(text) || ' ', ' {w} ')::int" for w in ws) for k, ws in T.STOP_WORDS.items()}


@q("with s as (select doc_id, text, len(regexp_extract_all(text, '\\S+')) as n, " + ", ".join(f"{v} as {k}" for k, v in _STOPS.items()) + " from documents) select doc_id, case when text is null or n < 10 or greatest(de, fr, it, en) = 0 then 'unknown' when de = greatest(de, fr, it, en) then 'de' when fr = greatest(de, fr, it, en) then 'fr' when it = greatest(de, fr, it, en) then 'it' else 'en' end as language from s")
def text_lang_model(spark, d):
    """The language by a model (here one of stop words), unknown below ten words."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)")))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNull() | (n < 10), "unknown").otherwise(T.language_by_stop_words(F.col("text"))).alias("language"))


@q("select distinct uid, year(tst_created)::int as year from job_postings_unified")
def cast_year_strict(spark, d):
    """The year in front of a date; one that can't be read is an error."""
    year = T.year_prefix(F.date_format("tst_created", "yyyy-MM-dd"))
    return table(spark, d, "job_postings_unified").select("uid", F.when(year.isNull(), F.raise_error(F.concat(F.lit("no year: "), F.col("uid")))).otherwise(year).cast("int").alias("year")).distinct()


@q("select distinct uid, list_filter(string_split_regex(coalesce(x28_occupations, ''), '[\\[\\]{}()''\"|,;\\s]+'), lambda x: x <> '') as codes from job_postings_unified")
def cast_parse_array(spark, d):
    return table(spark, d, "job_postings_unified").select("uid", T.codes(F.col("x28_occupations")).alias("codes")).distinct()


@q()
def hash_file_md5(spark, d):
    """Digests of the files of a reference table, to see that they drift."""
    f = spark.read.format("binaryFile").load(f"{d}/occupation_reference.parquet")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.md5("content").alias("md5"), "length")


# Columns ------------------------------------------------------------------


@q(f'select link_id, exposure_score as "exposure_score_{{pct_20}}_{{ce_0.8}}", year as "year_{{pct_20}}_{{ce_0.8}}" from {JOBS}')
def project_spec_suffix_isco(spark, d):
    suffix = "_{pct_20}_{ce_0.8}"
    return table(spark, d, JOBS).select("link_id", *[F.col(c).alias(c + suffix) for c in ("exposure_score", "year")])


@q(f"select link_id, exposure_score, year from {JOBS}")
def project_spec_unsuffix_jobs(spark, d):
    """The columns of one specification without its suffix."""
    suffix, df = "_{pct_20}_{ce_0.8}", project_spec_suffix_isco(spark, d)
    return df.select("link_id", *[F.col(f"`{c}`").alias(c.removesuffix(suffix)) for c in df.columns if c.endswith(suffix)])


@q("select 'isco_firm_year_ai_exposure' || case v when 1 then '_time_invariant' else '_time_variant' end || case w when 1 then '_weighted' else '' end as name from (select unnest([0, 1]) v), (select unnest([0, 1]) w)")
def project_filename_flags(spark, d):
    """The name of an output by its settings."""
    names = [(f"isco_firm_year_ai_exposure_time_{'invariant' if v else 'variant'}{'_weighted' if w else ''}",) for v in (0, 1) for w in (0, 1)]
    return spark.createDataFrame(names, "name string")


# Sinks and sources, read back ---------------------------------------------


@q(f"select link_id, company_id, year, exposure_score from {JOBS}")
def sink_csv(spark, d):
    at = _place(spark)
    files.write_csv(table(spark, d, JOBS).select("link_id", "company_id", "year", "exposure_score"), at)
    return files.csv(spark, at, "link_id bigint, company_id bigint, year int, exposure_score double")


@q(f"select company_id, count(*) as n from {JOBS} where company_id in (select company_id from step1_output) group by 1")
def sink_copy_to_csv(spark, d):
    """The rows of chosen firms as a CSV file, counted from it."""
    at = _place(spark)
    files.write_csv(table(spark, d, JOBS).join(table(spark, d, "step1_output").select("company_id"), "company_id", "left_semi").select("link_id", "company_id"), at)
    return files.csv(spark, at, "link_id bigint, company_id bigint").groupBy("company_id").agg(F.count("*").alias("n"))


@q(f"select (link_id % 4)::int as chunk, count(*) as n from {JOBS} group by 1")
def sink_parquet_chunk(spark, d):
    """Numbered chunks, one folder each, read as one table."""
    at = _place(spark)
    files.write_parquet(table(spark, d, JOBS).select("link_id", (F.col("link_id") % 4).cast("int").alias("chunk")), at, by=["chunk"])
    return spark.read.parquet(at).groupBy("chunk").agg(F.count("*").alias("n"))


@q("select count(distinct coalesce(content_clean, '')) as n_keys, count(distinct coalesce(content_clean, '')) as n_lines from step1_output")
def sink_jsonl_cache(spark, d):
    """Answers appended to a file of JSON lines by cache key; a second run finds
    all of them and appends none."""
    at = _place(spark)
    rows = table(spark, d, "step1_output").select("uid", "content_clean").distinct()
    for _ in range(2):
        fresh = models.completed(rows, "content_clean", models.EchoModel()).select("cache_key", "response").dropDuplicates(["cache_key"])
        if files.exists(spark, at):
            fresh = fresh.join(spark.read.schema("cache_key string, response string").json(at).select("cache_key"), "cache_key", "left_anti")
        fresh.write.mode("append").json(at)
    kept = spark.read.schema("cache_key string, response string").json(at)
    return kept.agg(F.countDistinct("cache_key").alias("n_keys"), F.count("*").alias("n_lines"))


_SAME = "regexp_replace(lower(content_clean), '[^a-z0-9]+', '', 'g')"
_KEPT = f"j as (select distinct uid, company_id, md5({_SAME}) h, length(content_clean) n from job_postings_unified where content_clean is not null and company_id is not null), k as (select company_id, h, min(uid) kept_uid, min_by(n, uid) n_kept from j group by 1, 2)"


@q(f"with {_KEPT} select j.uid, k.kept_uid, j.n, k.n_kept from j join k on j.company_id = k.company_id and j.h = k.h where j.uid <> k.kept_uid")
def sink_similar_pairs(spark, d):
    """Removed ads and the ones kept for them, with what both hold."""
    ads = table(spark, d, "job_postings_unified").filter("content_clean is not null and company_id is not null").select("uid", "company_id", F.md5(F.regexp_replace(F.lower("content_clean"), "[^a-z0-9]+", "").cast("binary")).alias("h"), F.length("content_clean").alias("n")).distinct()
    kept = ads.groupBy("company_id", "h").agg(F.min("uid").alias("kept_uid"), F.min_by("n", "uid").alias("n_kept"))
    return ads.join(kept, ["company_id", "h"]).filter(F.col("uid") != F.col("kept_uid")).select("uid", "kept_uid", "n", "n_kept").distinct()


@q("select isco_code, title_de from occupation_reference")
def source_excel_header_skip(spark, d):
    """A sheet whose header stands below lines of notes."""
    at = _place(spark)
    rows = table(spark, d, "occupation_reference").select(F.concat_ws(";", "isco_code", "title_de").alias("value"))
    notes = spark.createDataFrame([("# source of the sheet",), ("# as of today",)], "value string")
    notes.unionByName(rows).coalesce(1).write.text(at)
    return spark.read.option("sep", ";").option("comment", "#").schema("isco_code string, title_de string").csv(at)


@q("select distinct company_id from step1_output where company_id is not null")
def source_firm_id_csv(spark, d):
    at = _place(spark)
    files.write_csv(table(spark, d, "step1_output").select("company_id").dropna().distinct(), at)
    return files.csv(spark, at, "company_id bigint")


@q("select onet_task_id, max(cross_encoder_score) as score from similarity_df where cross_encoder_score is not null and not isnan(cross_encoder_score) group by 1")
def source_expertise_csv(spark, d):
    at = _place(spark)
    good = table(spark, d, "similarity_df").filter(F.col("cross_encoder_score").isNotNull() & ~F.isnan("cross_encoder_score"))
    files.write_csv(good.groupBy("onet_task_id").agg(F.max("cross_encoder_score").alias("score")), at)
    return files.csv(spark, at, "onet_task_id bigint, score double")


# Joins and aggregates -----------------------------------------------------


@q("with s as (select onet_task_id, max(cross_encoder_score) as score from similarity_df where not isnan(cross_encoder_score) and cross_encoder_score > 0.5 group by 1) select t.onet_task_id, s.score from (select distinct onet_task_id from similarity_df) t left join s on t.onet_task_id = s.onet_task_id")
def join_score_back(spark, d):
    """Scores onto all tasks; those without one stay."""
    s = table(spark, d, "similarity_df")
    scores = s.filter(~F.isnan("cross_encoder_score") & (F.col("cross_encoder_score") > 0.5)).groupBy("onet_task_id").agg(F.max("cross_encoder_score").alias("score"))
    return s.select("onet_task_id").distinct().join(scores, "onet_task_id", "left")


def _spec_sql(name, rule):
    return f"{name} as (select company_id, isco_code, year, round(avg(exposure_score) + 1e-9, 6) e from {_GOOD} where company_id is not null and isco_code is not null and {rule} group by 1, 2, 3)"


@q(f"with {_spec_sql('a', 'year < 2020')}, {_spec_sql('b', 'exposure_score > 0.5')} select company_id, isco_code, year, coalesce(a.e, 0) as e_a, coalesce(b.e, 0) as e_b from a full join b using (company_id, isco_code, year)")
def join_outer_specs_isco(spark, d):
    """Two specifications side by side; what one lacks is 0."""
    keys = ["company_id", "isco_code", "year"]
    rows = _jobs(spark, d).filter("company_id is not null and isco_code is not null")
    mean = lambda cond, name: rows.filter(cond).groupBy(*keys).agg(F.round(F.avg("exposure_score") + 1e-9, 6).alias(name))
    both = mean("year < 2020", "e_a").join(mean("exposure_score > 0.5", "e_b"), keys, "full")
    return both.na.fill(0.0, ["e_a", "e_b"])


@q(f"with m as (select company_id, year, round(avg(exposure_score) + 1e-9, 6) e from {_GOOD} where company_id is not null group by 1, 2) select j.link_id, m.e as exposure_firm_year from {JOBS} j left join m on j.company_id = m.company_id and j.year = m.year")
def join_level(spark, d):
    """One level's exposure, suffixed by its name, onto all rows."""
    m = _jobs(spark, d).filter("company_id is not null").groupBy("company_id", "year").agg(F.round(F.avg("exposure_score") + 1e-9, 6).alias("exposure"))
    return table(spark, d, JOBS).join(m.withColumnRenamed("exposure", "exposure_firm_year"), ["company_id", "year"], "left").select("link_id", "exposure_firm_year")


@q(f"select isco_code, round(avg(exposure_score) + 1e-9, 6) as exposure from {_GOOD} where regexp_matches(isco_code, '^[0-9]{{4}}$') group by 1")
def agg_load_level(spark, d):
    return _jobs(spark, d).filter(F.col("isco_code").rlike("^[0-9]{4}$")).groupBy("isco_code").agg(F.round(F.avg("exposure_score") + 1e-9, 6).alias("exposure"))


@q("select ai_app_id, array_to_string(list_sort(list_distinct(flatten(list(job_uid)))), '|') as uids from similarity_df where job_uid is not null and cross_encoder_score > 0.3 and not isnan(cross_encoder_score) group by 1")
def agg_job_app_map_exh(spark, d):
    """The ads of each app, from the retained matches alone."""
    kept = table(spark, d, "similarity_df").filter((F.col("cross_encoder_score") > 0.3) & ~F.isnan("cross_encoder_score"))
    return kept.filter("job_uid is not null").groupBy("ai_app_id").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("job_uid")))), "|").alias("uids"))


@q("select o_orderpriority as outcome, " + ", ".join(f"round(avg(o_totalprice) filter (where o_orderstatus = '{s}'), 4) as \"{s}\"" for s in "FOP") + " from orders group by 1")
def agg_pivot_coef(spark, d):
    """Outcomes by models."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("outcome")).pivot("o_orderstatus", list("FOP")).agg(F.round(F.avg("o_totalprice"), 4))


@q(f"with {_P}, g as (select id, min(yr) g from p where n >= 3 group by 1) select (yr - g)::int as t, count(*) as n, round(avg(v), 6) as mean from p join g using (id) group by 1")
def agg_adoption_means(spark, d):
    """Means by years since adoption, of those who adopt."""
    p = _panel(spark, d)
    g = p.filter("n >= 3").groupBy("id").agg(F.min("year").alias("g"))
    return p.join(g, "id").groupBy((F.col("year") - F.col("g")).cast("int").alias("t")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


_PAIR = "p as (select a.uid, a.step2_output x, b.step3_output y from (select distinct uid, step2_output from step2_output) a join (select distinct uid, step3_output from step3_output) b on a.uid = b.uid)"
_BLANK = lambda c: f"trim(coalesce({c}, '')) in ('', '[]', 'N/A')"


@q(f"with {_PAIR} select case when {_BLANK('x')} and {_BLANK('y')} then 'both empty' when {_BLANK('x')} or {_BLANK('y')} then 'one empty' when x = y then 'exact' else 'different' end as match_type, count(*) as n, round(avg(length(coalesce(y, ''))), 4) as mean_length from p group by 1")
def agg_macro_step3(spark, d):
    """Predictions beside the truth: kinds of match and mean lengths."""
    p = table(spark, d, "step2_output").select("uid", F.col("step2_output").alias("x")).distinct().join(table(spark, d, "step3_output").select("uid", F.col("step3_output").alias("y")).distinct(), "uid")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))).isin("", "[]", "N/A")
    kind = F.when(blank("x") & blank("y"), "both empty").when(blank("x") | blank("y"), "one empty").when(F.col("x") == F.col("y"), "exact").otherwise("different")
    return p.groupBy(kind.alias("match_type")).agg(F.count("*").alias("n"), F.round(F.avg(F.length(F.coalesce("y", F.lit("")))), 4).alias("mean_length"))


_CHANGE = f"c as (select isco_code, round(avg(exposure_score) filter (where year >= 2020) - avg(exposure_score) filter (where year < 2020), 6) as change from {_GOOD} where isco_code is not null group by 1)"


def _changes(spark, d):
    late, early = (F.avg(F.when(c, F.col("exposure_score"))) for c in (F.col("year") >= 2020, F.col("year") < 2020))
    return _jobs(spark, d).filter("isco_code is not null").groupBy("isco_code").agg(F.round(late - early, 6).alias("change")).filter("change is not null")


@q(f"with {_CHANGE} (select 'gain' as side, isco_code, change from c where change is not null order by change desc, isco_code limit 10) union all (select 'loss', isco_code, change from c where change is not null order by change, isco_code limit 10)")
def sort_rank_occ_expertise(spark, d):
    """The ten occupations that gain and the ten that lose most."""
    c = _changes(spark, d)
    side = lambda name, o: c.orderBy(o, "isco_code").limit(10).select(F.lit(name).alias("side"), "isco_code", "change")
    return side("gain", F.desc("change")).unionByName(side("loss", F.asc("change")))


@q(f"with {_CHANGE} select isco_code, change, rank() over (order by abs(change) desc) as rank from c where change is not null order by abs(change) desc, isco_code limit 15")
def sort_sensitivity_occ(spark, d):
    """The fifteen occupations whose exposure depends most on the period."""
    top = _changes(spark, d).orderBy(F.desc(F.abs("change")), "isco_code").limit(15)
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc(F.abs("change")))).cast("bigint"))


# Runs that go on where they stopped ---------------------------------------


@q("select (event_id % 4)::int as chunk, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_resume(spark, d):
    """Chunks that are done are not done again: the first run stops after two of
    four, the second does the rest."""
    rows = table(spark, d, "events").withColumn("chunk", (F.col("event_id") % 4).cast("int"))
    at = _place(spark)
    one = lambda df: df.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    batches.resumed(rows, "chunk", [0, 1, 2, 3], one, at, stop_after=2)
    return batches.resumed(rows, "chunk", [0, 1, 2, 3], one, at)
