"""First-row rules. "First" always means the smallest ordinal, never the row that happens to
arrive first. Everything is an aggregation with partial results before the shuffle, so a
group of copies that holds a large share of the rows costs one partial row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def ordinal(columns: Sequence[str]) -> Column:
    return F.struct(*columns) if len(columns) > 1 else F.col(columns[0])


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """The row with the smallest ordinal of each key, with optional further aggregates."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), ordinal(order)).alias("_first"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return picked.select(
        *[F.col(c) if c in key else F.col("_first")[c].alias(c) for c in df.columns], *(extra or {}))


def best_per_key(df: DataFrame, key: Sequence[str], score: Column, ties: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest score of each key; of equal scores that with the greatest values in the columns `ties`."""
    rest = [c for c in df.columns if c not in key]
    by = F.struct(score.alias("_score"), *[c for c in ties if c in df.columns])
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_best"))
    return picked.select(*[F.col(c) if c in key else F.col("_best")[c].alias(c) for c in df.columns])
