"""Affinity of entities to tags: shares, tag baselines, z-scores, ranks, flags, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from affinis.config import AFFINITY_COLUMNS, AffinityConfig
from affinis.functions.numbers import finite, ratio
from affinis.operators.checks import require_analysis_input
from affinis.operators.ranking import value_ranks, window_ranks
from affinis.operators.reports import count_rows, report


def add_share(df: DataFrame) -> DataFrame:
    """tag_n / total_n as a fraction and as a percentage."""
    share = ratio("tag_n", "total_n")
    return df.withColumn("tag_affinity_pct", share).withColumn("tag_affinity_pct_display", share * 100.0)


def tag_baselines(df: DataFrame) -> DataFrame:
    """Mean, sample standard deviation and row count of the shares of each tag."""
    return df.groupBy("tag_slug").agg(
        F.avg("tag_affinity_pct").alias("tag_mean_pct"),
        F.stddev_samp("tag_affinity_pct").alias("tag_std_pct"),
        count_rows().alias("tag_row_count"),
    )


def z_score():
    """Distance from the tag mean in standard deviations; null without a spread."""
    spread = F.col("tag_std_pct")
    return F.when(spread > 0, finite((F.col("tag_affinity_pct") - F.col("tag_mean_pct")) / spread))


def add_scores(df: DataFrame) -> DataFrame:
    """Shares with their tag's baseline and the z-score."""
    return df.join(tag_baselines(df), "tag_slug", "left").withColumn("z", z_score())


def share_table(df: DataFrame, ranks=value_ranks) -> DataFrame:
    """Per (tag, share): baseline, z, ranks and percentile, everything that follows from the
    share alone. It is as small as the number of distinct shares."""
    ranked = ranks(df, "tag_slug", "tag_affinity_pct")
    scored = ranked.join(tag_baselines(df), "tag_slug").withColumn("z", z_score())
    # z grows with the share, so the few shares that give one z are neighbours and their
    # common rank is the best rank by share among them.
    same_z = Window.partitionBy("tag_slug", "z")
    return scored.select(
        "tag_slug", "tag_affinity_pct", "tag_mean_pct", "tag_std_pct", "tag_row_count", "z",
        F.when(F.col("z").isNotNull(), F.min("rank_desc").over(same_z)).alias("rank_within_tag_by_z"),
        F.col("rank_desc").alias("rank_within_tag_by_pct"),
        (F.col("rank_asc") / F.col("n_group")).alias("percentile_within_tag"),
    )


def add_scores_and_ranks(df: DataFrame, ranks=value_ranks) -> DataFrame:
    """Rows with z, the three ranks within the tag and the percentile within the tag.

    All figures come from tables of distinct values, which meet the rows in two equi joins;
    a tag that holds a large share of the rows is spread over its values.
    """
    by_count = ranks(df, "tag_slug", "tag_n").select(
        "tag_slug", "tag_n", F.col("rank_desc").alias("rank_within_tag_by_tag_n"))
    return (
        df.join(share_table(df, ranks), ["tag_slug", "tag_affinity_pct"], "left")
        .join(by_count, ["tag_slug", "tag_n"], "left")
    )


def add_flags(df: DataFrame, config: AffinityConfig = AffinityConfig()) -> DataFrame:
    """Sample-size flag and eligibility for the leaderboard."""
    passes = F.coalesce((F.col("total_n") >= config.min_total_n) & (F.col("tag_n") >= config.min_tag_n), F.lit(False))
    spread = F.col("z").isNotNull() & F.coalesce(F.col("tag_std_pct") > 0, F.lit(False))
    return (
        df.withColumn("passes_default_filters", passes)
        .withColumn("analysis_eligible", passes & spread & F.coalesce(F.col("tag_row_count") > 1, F.lit(False)))
    )


def order_columns(df: DataFrame, preferred=AFFINITY_COLUMNS) -> DataFrame:
    """Preferred columns first, the others behind them as they were."""
    known = [c for c in preferred if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def analyse(df: DataFrame, config: AffinityConfig = AffinityConfig(), *, check: bool = True, ranks=value_ranks) -> DataFrame:
    """The affinity table of a clean fact table.

    `check` reads the input once more to refuse rows that would make the figures misleading.
    """
    if check:
        require_analysis_input(df)
    return order_columns(add_flags(add_scores_and_ranks(add_share(df), ranks), config))


def global_leaderboard(affinity: DataFrame) -> DataFrame:
    """Eligible rows, strongest first."""
    return affinity.where("analysis_eligible").orderBy(
        F.col("z").desc_nulls_last(), F.col("tag_n").desc_nulls_last(),
        F.col("total_n").desc_nulls_last(), F.col("entity_name").asc_nulls_last(),
        "entity_slug", "tag_slug",
    )


def tag_rankings(affinity: DataFrame) -> DataFrame:
    """All rows, tag by tag in rank order."""
    ranks = ("rank_within_tag_by_z", "rank_within_tag_by_pct", "rank_within_tag_by_tag_n", "entity_name")
    return affinity.orderBy("tag_slug", *[F.col(c).asc_nulls_last() for c in ranks], "entity_slug")


def tag_summary(affinity: DataFrame) -> DataFrame:
    """One row per tag: rows, eligible rows, mean, spread and maxima."""
    return (
        affinity.groupBy("tag_slug", "tag_name").agg(
            count_rows().alias("tag_row_count"),
            F.count_if("analysis_eligible").alias("eligible_row_count"),
            F.avg("tag_affinity_pct").alias("tag_mean_pct"),
            F.stddev_samp("tag_affinity_pct").alias("tag_std_pct"),
            F.max("z").alias("max_z"),
            F.max("tag_n").alias("max_tag_n"),
            F.max("total_n").alias("max_total_n"),
        ).orderBy("tag_slug", "tag_name")
    )


def analysis_summary(affinity: DataFrame, config: AffinityConfig = AffinityConfig()) -> DataFrame:
    """One row of run figures."""
    pairs = affinity.select("tag_slug", "tag_name").distinct()
    figures = report([
        (affinity, {
            "affinity_row_count": count_rows(),
            "global_leaderboard_row_count": F.count_if("analysis_eligible"),
            "analysis_eligible_row_count": F.count_if("analysis_eligible"),
            "rows_with_missing_z": F.count_if(F.col("z").isNull()),
        }),
        (affinity.select("entity_slug").distinct(), {"unique_entity_count": count_rows()}),
        (pairs, {"tag_summary_row_count": count_rows(), "unique_tag_count": F.countDistinct("tag_slug")}),
    ])
    return figures.select(
        "*",
        F.lit(config.min_total_n).cast("bigint").alias("min_total_n_default"),
        F.lit(config.min_tag_n).cast("bigint").alias("min_tag_n_default"),
    )
