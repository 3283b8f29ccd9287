"""Affinity, ranks, leaderboard and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.operators import affinity as af
from affinis.operators.ranking import value_ranks
from affinis.session import materialise
from catalog.fixtures import PAIRS_SQL, STRICT, affinity_sql, pairs
from catalog.registry import query, rounded

WITH = "WITH " + PAIRS_SQL
SCORED = WITH + "," + affinity_sql()
KEYS = ("entity_slug", "tag_slug")


def analysed(spark, folder):
    return af.analyse(materialise(pairs(spark, folder)), STRICT, check=False)


@query("affinity_pairs", WITH + """
SELECT entity_name, entity_slug, tag_name, tag_slug, total_n, tag_n, round(tag_n::DOUBLE / total_n, 6) AS tag_affinity_pct,
       round(tag_n::DOUBLE / total_n * 100.0, 6) AS tag_affinity_pct_display FROM pairs""")
def affinity_pairs(spark, folder):
    return rounded(af.add_share(pairs(spark, folder)).select(
        "entity_name", *KEYS[:1], "tag_name", "tag_slug", "total_n", "tag_n", "tag_affinity_pct", "tag_affinity_pct_display"))


@query("affinity_scored", SCORED + """
SELECT entity_slug, tag_slug, total_n, tag_n, round(tag_affinity_pct, 6) AS tag_affinity_pct, round(tag_mean_pct, 6) AS tag_mean_pct,
       round(tag_std_pct, 6) AS tag_std_pct, tag_row_count, round(z, 6) AS z, passes_default_filters, analysis_eligible FROM affinity""")
def affinity_scored(spark, folder):
    scored = af.add_flags(af.add_scores(af.add_share(pairs(spark, folder))), STRICT)
    return rounded(scored.select(*KEYS, "total_n", "tag_n", "tag_affinity_pct", "tag_mean_pct", "tag_std_pct",
                                 "tag_row_count", "z", "passes_default_filters", "analysis_eligible"))


RANKS = ("rank_within_tag_by_z", "rank_within_tag_by_pct", "rank_within_tag_by_tag_n", "percentile_within_tag")


@query("affinity_ranks", SCORED + """
SELECT entity_slug, tag_slug, rank_within_tag_by_z, rank_within_tag_by_pct, rank_within_tag_by_tag_n,
       round(percentile_within_tag, 6) AS percentile_within_tag FROM affinity""")
def affinity_ranks(spark, folder):
    return rounded(analysed(spark, folder).select(*KEYS, *RANKS))


@query("affinity_ranks_histogram", SCORED + """
SELECT tag_slug, tag_n, count(*) AS n_equal, any_value(tag_row_count) AS n_group, min(rank_within_tag_by_tag_n) AS rank_desc,
       round(any_value(tag_row_count) - min(rank_within_tag_by_tag_n) + 1 - (count(*) - 1) / 2.0, 6) AS rank_asc
FROM affinity GROUP BY tag_slug, tag_n""")
def affinity_ranks_histogram(spark, folder):
    return rounded(value_ranks(pairs(spark, folder), "tag_slug", "tag_n"))


@query("global_leaderboard", SCORED + """
SELECT entity_name, entity_slug, tag_name, tag_slug, total_n, tag_n, round(z, 6) AS z, rank_within_tag_by_z
FROM affinity WHERE analysis_eligible""")
def global_leaderboard(spark, folder):
    return rounded(af.global_leaderboard(analysed(spark, folder)).select(
        "entity_name", "entity_slug", "tag_name", "tag_slug", "total_n", "tag_n", "z", "rank_within_tag_by_z"))


@query("tag_rankings", SCORED + """
SELECT entity_name, entity_slug, tag_name, tag_slug, source_type, observed_at, total_n, tag_n,
       round(tag_affinity_pct, 6) AS tag_affinity_pct, round(tag_affinity_pct_display, 6) AS tag_affinity_pct_display,
       round(tag_mean_pct, 6) AS tag_mean_pct, round(tag_std_pct, 6) AS tag_std_pct, tag_row_count, round(z, 6) AS z,
       rank_within_tag_by_z, rank_within_tag_by_pct, rank_within_tag_by_tag_n,
       round(percentile_within_tag, 6) AS percentile_within_tag, passes_default_filters, analysis_eligible FROM affinity""")
def tag_rankings(spark, folder):
    return rounded(af.tag_rankings(analysed(spark, folder)))


@query("tag_summary", SCORED + """
SELECT tag_slug, tag_name, count(*) AS tag_row_count, count(*) FILTER (WHERE analysis_eligible) AS eligible_row_count,
       round(avg(tag_affinity_pct), 6) AS tag_mean_pct, round(stddev_samp(tag_affinity_pct), 6) AS tag_std_pct,
       round(max(z), 6) AS max_z, max(tag_n) AS max_tag_n, max(total_n) AS max_total_n FROM affinity GROUP BY tag_slug, tag_name""")
def tag_summary(spark, folder):
    return rounded(af.tag_summary(analysed(spark, folder)))


@query("analysis_summary", SCORED + """
SELECT count(*) AS affinity_row_count, count(*) FILTER (WHERE analysis_eligible) AS global_leaderboard_row_count,
       count(*) FILTER (WHERE analysis_eligible) AS analysis_eligible_row_count, count(*) FILTER (WHERE z IS NULL) AS rows_with_missing_z,
       count(DISTINCT entity_slug) AS unique_entity_count, count(DISTINCT (tag_slug, tag_name)) AS tag_summary_row_count,
       count(DISTINCT tag_slug) AS unique_tag_count, 450::BIGINT AS min_total_n_default, 20::BIGINT AS min_tag_n_default FROM affinity""")
def analysis_summary(spark, folder):
    return af.analysis_summary(analysed(spark, folder), STRICT)
