"""Text, hash, list and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasklattice.functions import keywords as K
from tasklattice.functions import structured as S
from tasklattice.functions import text as T
from tasklattice.operators import dedup, sampling
from tasklattice.queries.registry import Register
from tasklattice.sources.tables import table

q = Register()
QUERIES, SQL = q.queries, q.sql

TERMS = ["ki", "ai", "bild", "neural networks", "künstlicher intelligenz", "modelle", "sql", "e.g."]
_SPACE = T.SPACE.replace("'", "''")
_UNLIGATED = "text_"
for _k, _v in T.LETTERS.items():
    _UNLIGATED = f"replace({_UNLIGATED}, '{_k}', '{_v}')"
_ADS = "(select distinct uid, content_clean as text_ from job_postings_unified where content_clean is not null)"


def _ads(spark, d):
    return table(spark, d, "job_postings_unified").filter("content_clean is not null")


@q(f"select doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '{_SPACE}+', ' ', 'g')) as t from documents")
def text_normalize_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_ascii(F.col("text")).alias("t"))


@q(f"select uid, md5(trim(regexp_replace(regexp_replace(lower(strip_accents({_UNLIGATED})), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '{_SPACE}+', ' ', 'g'))) as h from {_ADS}")
def text_normalize_db(spark, d):
    return _ads(spark, d).select("uid", F.md5(T.normalize_db(F.col("content_clean")).cast("binary")).alias("h")).distinct()


@q("select distinct title, coalesce(trim(regexp_replace(regexp_replace(lower(title), '[“”„«»‘’'']', '\"', 'g'), '\\s+', ' ', 'g')), '') as canonical from job_postings_unified")
def text_canonicalize(spark, d):
    return table(spark, d, "job_postings_unified").select("title", T.canonicalize(F.col("title")).alias("canonical")).distinct()


@q(f"select distinct company_name, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(company_name)), '[^a-z0-9 ]', ' ', 'g'), '\\b({T.FIRM_WORDS})\\b', ' ', 'g'), '\\s+', ' ', 'g')) as firm from job_postings_unified where company_name is not null")
def text_normalize_firm(spark, d):
    return table(spark, d, "job_postings_unified").filter("company_name is not null").select("company_name", T.normalize_firm(F.col("company_name")).alias("firm")).distinct()


@q("select distinct company_name, strip_accents(company_name) as plain from job_postings_unified")
def text_strip_accents(spark, d):
    return table(spark, d, "job_postings_unified").select("company_name", T.strip_accents(F.col("company_name")).alias("plain")).distinct()


@q()
def text_html_clean(spark, d):
    """All documents, with or without tags and entities."""
    return table(spark, d, "documents").select("doc_id", T.each(T.html_text_of, F.col("text")).alias("t"))


def _any(terms, column):
    k = T.pattern_classes(terms)
    parts = [T.word_pattern(t) for t in k["dotted"] + k["short"]] + k["long"] + [T.flexible_phrase(t) for t in k["phrase"]]
    return f"regexp_matches({column}, '" + "|".join(f"(?:{p})" for p in parts) + "')"


# The texts stay where they are read: one pass finds all terms, and only uids and
# what was found are shuffled, as an ad may be delivered again.
_LOWER = "lower(text_)"


@q(f"select distinct uid from {_ADS} where {_any(TERMS, _LOWER)}")
def filter_keyword_or(spark, d):
    return _ads(spark, d).filter(K.any_of(F.col("content_clean"), TERMS)).select("uid").distinct()


@q(f"select distinct uid from job_postings_unified where tst_created >= timestamptz '2018-01-01 00:00:00+00' and tst_created < timestamptz '2018-07-01 00:00:00+00' and {_any(TERMS, 'lower(content_clean)')}")
def filter_keyword_batch(spark, d):
    t = F.col("tst_created")
    rows = table(spark, d, "job_postings_unified").filter((t >= F.lit("2018-01-01").cast("timestamp")) & (t < F.lit("2018-07-01").cast("timestamp")))
    return rows.filter(K.any_of(F.col("content_clean"), TERMS)).select("uid").distinct()


_HITS = "list_filter([" + ", ".join(f"case when regexp_matches(lower(text_), '{T.word_pattern(t)}') then '{t}' end" for t in TERMS) + "], lambda x: x is not null)"


@q(f"select distinct uid, array_to_string(list_sort({_HITS}), ', ') as matched from {_ADS}")
def text_match_keywords(spark, d):
    return _ads(spark, d).select("uid", K.matched(F.col("content_clean"), TERMS).alias("matched")).distinct()


@q(f"select distinct uid from {_ADS} where len({_HITS}) > 0")
def filter_verified(spark, d):
    """What the loose patterns retrieve, verified by the matcher."""
    return _ads(spark, d).filter(K.matched(F.col("content_clean"), TERMS) != "").select("uid").distinct()


@q(f"select distinct uid from job_postings_unified where regexp_matches(lower(title), '{T.spaced_letters('hr')}|{T.spaced_letters('sw')}|{T.word_pattern('sw')}')")
def text_punct_regex(spark, d):
    p = "|".join((T.spaced_letters("hr"), T.spaced_letters("sw"), T.word_pattern("sw")))
    return table(spark, d, "job_postings_unified").filter(F.lower("title").rlike(p)).select("uid").distinct()


_SCORE = {k: " + ".join(f"contains(' ' || lower(text) || ' ', ' {w} ')::int" for w in ws) for k, ws in T.STOP_WORDS.items()}


@q("with s as (select doc_id, text, " + ", ".join(f"{v} as {k}" for k, v in _SCORE.items()) + " from documents) select doc_id, case when text is null or greatest(de, fr, it, en) = 0 then 'unknown' when de = greatest(de, fr, it, en) then 'de' when fr = greatest(de, fr, it, en) then 'fr' when it = greatest(de, fr, it, en) then 'it' else 'en' end as language from s")
def text_lang_stopwords(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_by_stop_words(F.col("text")).alias("language"))


@q(f"select doc_id, md5(coalesce(trim(regexp_replace(lower(text), '{_SPACE}+', ' ', 'g')), '')) as h from documents")
def hash_md5_content(spark, d):
    return table(spark, d, "documents").select("doc_id", T.md5_content(F.col("text")).alias("h"))


@q("select distinct app_text, upper(md5(app_text)) as app_id from similarity_df")
def hash_md5_app_id(spark, d):
    return table(spark, d, "similarity_df").select("app_text", T.app_id(F.col("app_text")).alias("app_id")).distinct()


@q("select distinct uid, sha256(uid || '|' || coalesce(title, '')) as k from job_postings_unified")
def hash_sha256_key(spark, d):
    return table(spark, d, "job_postings_unified").select("uid", F.sha2(F.concat("uid", F.lit("|"), F.coalesce("title", F.lit(""))), 256).alias("k")).distinct()


@q("select distinct uid, case when trim(url) <> '' and trim(title) <> '' then 'surr_' || sha1(url || '|' || title) when trim(company_name) <> '' then 'surr_' || sha1(company_name || '|' || uid) end as surrogate from job_postings_unified")
def hash_sha1_surrogate(spark, d):
    c = F.col
    return table(spark, d, "job_postings_unified").select("uid", T.surrogate_uid([c("url"), c("title")], [c("company_name"), c("uid")]).alias("surrogate")).distinct()


@q("with n as (select distinct uid, ('0x' || substring(md5(uid), 1, 8))::bigint u from job_postings_unified), s as (select uid, case when u >= 2147483648 then u - 4294967296 else u end as number from n) select uid, number from s where number % 1000 < 50")
def hash_md5_mod_sample(spark, d):
    n = table(spark, d, "job_postings_unified").select("uid", T.md5_number(F.col("uid")).alias("number")).distinct()
    return n.filter(F.col("number") % 1000 < 50)


@q("select distinct uid, list_filter(string_split_regex(coalesce(x28_occupations, ''), '[\\[\\]{}()''\"|,;\\s]+'), lambda x: x <> '') as codes from job_postings_unified")
def array_parse_codes(spark, d):
    return table(spark, d, "job_postings_unified").select("uid", T.codes(F.col("x28_occupations")).alias("codes")).distinct()


@q("select distinct uid, unnest(case when len(x) = 0 then [null] else x end) as code from (select uid, list_filter(string_split_regex(coalesce(x28_occupations, ''), '[\\[\\]{}()''\"|,;\\s]+'), lambda x: x <> '') x from job_postings_unified)")
def array_explode_outer(spark, d):
    return table(spark, d, "job_postings_unified").select("uid", F.explode_outer(T.codes(F.col("x28_occupations"))).alias("code")).distinct()


@q("select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def array_split_pipe(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(T.split_pipe(F.replace("p_name", F.lit(" "), F.lit("|")))).alias("word"))


@q("select distinct uid, cantons[1] as canton from job_postings_unified")
def array_flatten(spark, d):
    return table(spark, d, "job_postings_unified").select("uid", F.try_element_at("cantons", F.lit(1)).alias("canton")).distinct()


@q("select event_id, (props->>'k')::bigint as k from events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@q()
def json_items(spark, d):
    """One row per statement of the responses, in whatever notation."""
    return S.exploded(table(spark, d, "step1_output").select("uid", "ai_applications_raw").distinct(), "uid", "ai_applications_raw")


@q()
def json_validate(spark, d):
    return table(spark, d, "step2_output").select("uid", S.malformed(F.col("step2_output")).alias("reason")).distinct()


@q("select distinct uid, coalesce(nullif(trim(title), ''), nullif(trim(company_name), '')) as label from job_postings_unified")
def json_coalesce_keys(spark, d):
    c = F.col
    return table(spark, d, "job_postings_unified").select("uid", F.trim(S.first_filled(c("title"), c("company_name"))).alias("label")).distinct()


@q("select distinct p, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' when p < 0.1 then '+' else '' end as stars from (select l_discount p from lineitem)")
def text_significance(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_discount").alias("p"), T.significance(F.col("l_discount")).alias("stars")).distinct()


@q("select distinct isco_code, ends_with(isco_code, '0') or length(isco_code) < 4 as broad from stage6_jobs_linked__jobads_isco_variant where isco_code is not null")
def text_broad_code(spark, d):
    return table(spark, d, "stage6_jobs_linked__jobads_isco_variant").filter("isco_code is not null").select("isco_code", T.broad_code(F.col("isco_code")).alias("broad")).distinct()


@q("with b as (select min(o_orderdate) a, max(o_orderdate) z from orders), r as (select unnest(generate_series(a, z, interval 6 month)) s from b) select s as range_start, least(s + interval 6 month, z) as range_end from r, b")
def date_months_ranges(spark, d):
    b = table(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    r = b.select("z", F.explode(F.sequence("a", "z", F.expr("interval 6 months"))).alias("range_start"))
    return r.select("range_start", F.least(F.col("range_start") + F.expr("interval 6 months"), F.col("z")).alias("range_end"))


@q()
def dedup_tfidf(spark, d):
    """Ads of one firm and title whose words nearly agree; the earliest stays."""
    rows = table(spark, d, "job_postings_unified").filter("content_clean is not null and company_id is not null and title is not null").dropDuplicates(["uid"])
    return dedup.near_copies(rows.select("uid", "company_id", "title", "content_clean", "tst_created"))


@q()
def join_greedy_match(spark, d):
    """One-to-one pairs of the statements of two steps, the most alike first."""
    a = S.exploded(table(spark, d, "step1_output").select("uid", "ai_applications_raw").distinct(), "uid", "ai_applications_raw")
    b = S.exploded(table(spark, d, "step2_output").select("uid", "step2_output").distinct(), "uid", "step2_output")
    return dedup.greedy_pairs(a, b, "uid")


@q("select distinct uid from job_postings_unified where company_id in (select company_id from (select distinct company_id from job_postings_unified where company_id is not null) order by md5(company_id::varchar || 'seed'), company_id limit 40)")
def sample_companies_seeded(spark, d):
    rows = table(spark, d, "job_postings_unified")
    return sampling.entities(rows, "company_id", 40, "seed").select("uid").distinct()


@q("select distinct company_id, (('0x' || substring(md5(company_id::varchar), 1, 8))::bigint % 2)::int as half from job_postings_unified where company_id is not null")
def sample_split_group(spark, d):
    rows = table(spark, d, "job_postings_unified").filter("company_id is not null").select("company_id").distinct()
    return rows.withColumn("half", sampling.bucket("company_id", 2))


@q()
def sample_complete_companies(spark, d):
    """Whole firms of all size classes until about 300 ads are reached."""
    return sampling.whole_entities(table(spark, d, "job_postings_unified").dropDuplicates(["uid"]), "company_id", 300, "seed")
