"""The queries of the training-data operators and the SQL for those that have it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tasklattice.llm import broken_responses, canonical_values, languages, mixing, name_variants, packing, personal_information, structural_copies, text_statistics, vector_neighbours
from tasklattice.llm.common import ads
from tasklattice.sources.tables import table  # noqa: F401


def p6_found(spark, d):
    return structural_copies.copies_of(ads(spark, d, "company_id", "content_clean"))


def p6_collapsed(spark, d):
    return structural_copies.collapsed(ads(spark, d, "company_id", "content_clean"))


def p7_found(spark, d):
    reference = table(spark, d, "occupation_reference")
    parts = {
        "title": canonical_values.map_titles(ads(spark, d, "title"), "uid", "title", reference),
        "x28_occupations": canonical_values.map_code_lists(ads(spark, d, "x28_occupations"), "uid", "x28_occupations", table(spark, d, "x28_isco_crosswalk")),
        "isco_code": canonical_values.map_codes(table(spark, d, "stage6_jobs_linked__jobads_isco_variant"), "link_id", "isco_code", reference),
    }
    return reduce(lambda a, b: a.unionByName(b), (df.select(F.lit(k).alias("field"), "row_key", "isco_code") for k, df in parts.items()))


def p3_found(spark, d):
    return name_variants.linked_names(table(spark, d, "job_postings_unified").select("company_name", "company_is_recruiter"))


def p3_firms(spark, d):
    return name_variants.firms(table(spark, d, "job_postings_unified").select("company_name", "company_is_recruiter"))


def p10_found(spark, d):
    return text_statistics.not_prose(table(spark, d, "documents"))


def p10_statistics(spark, d):
    return text_statistics.document_statistics(table(spark, d, "documents"))


def _profiles(spark, d):
    return languages.fitted(ads(spark, d, "content_clean"), table(spark, d, "ad_language_labels"), table(spark, d, "occupation_reference"))


def p1_found(spark, d):
    return languages.mislabelled(ads(spark, d, "title", "content_clean"), table(spark, d, "ad_language_labels"), _profiles(spark, d))


def p1_segments(spark, d):
    return languages.ad_segments(ads(spark, d, "title", "content_clean"), _profiles(spark, d))


STEPS = {1: ("content_clean", "ai_applications_raw"), 2: ("ai_applications_raw", "step2_output"), 3: ("step2_output", "step3_output")}


def _flags(spark, d):
    steps = [table(spark, d, f"step{n}_output").select(F.lit(n).alias("step_no"), "uid", F.col(p).alias("prompt"), F.col(r).alias("response")) for n, (p, r) in STEPS.items()]
    return broken_responses.flagged(reduce(lambda a, b: a.unionByName(b), steps), _profiles(spark, d))


def p5_found(spark, d):
    return broken_responses.first(_flags(spark, d))


def p5_all_defects(spark, d):
    return _flags(spark, d)


def p2_found(spark, d):
    return personal_information.found_types(ads(spark, d, "content_clean", "company_name"))


def p2_masked(spark, d):
    return personal_information.mask_ads(ads(spark, d, "content_clean", "company_name"))


def p4_found(spark, d):
    return vector_neighbours.linked(table(spark, d, "text_vectors"))


def _capacities(spark, d):
    kinds = table(spark, d, "container_sizes").filter(F.col("container_kind").isNotNull()).groupBy("container_kind").agg(F.max("capacity_tokens").alias("c"))
    return {r.container_kind: r.c for r in kinds.collect()}


def p8_containers(spark, d):
    return packing.packed(table(spark, d, "documents"), _capacities(spark, d))


def p8_use(spark, d):
    return packing.use(p8_containers(spark, d), _capacities(spark, d))


def p9_mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixture(docs, targets)[0], targets)


QUERIES = {"p4_found": p4_found, "p8_containers": p8_containers, "p8_use": p8_use, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p2_found": p2_found, "p2_masked": p2_masked, "p1_found": p1_found, "p1_segments": p1_segments, "p5_found": p5_found, "p5_all_defects": p5_all_defects, "p10_found": p10_found, "p10_statistics": p10_statistics, "p3_found": p3_found, "p3_firms": p3_firms, "p7_found": p7_found, "p6_found": p6_found, "p6_collapsed": p6_collapsed}
SQL: dict[str, str] = {
    "p4_found": """
        with v as (select vec_id, vec::double[] as vec from text_vectors where vec is not null and list_inner_product(vec::double[], vec::double[]) > 0),
        c as (select a.vec_id a, b.vec_id b, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.vec, b.vec) desc, b.vec_id) r
              from v a join v b on a.vec_id <> b.vec_id)
        select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from c where r <= 5""",
}
