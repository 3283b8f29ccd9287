"""Choice among dated snapshots."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, Window, functions as F


def is_before(name: str, current: str) -> bool:
    """Whether a snapshot is dated and older than the current one; when the current name is no date, any dated one but it counts as older."""
    def dated(text: str) -> bool:
        try:
            return bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text)) and bool(datetime.date.fromisoformat(text))
        except ValueError:
            return False

    return dated(name) and name != current and (not dated(current) or name < current)


def snapshot_dates(sizes: DataFrame, name: str = "snapshot_date") -> DataFrame:
    """Sizes with the snapshot name read as a date; names that are no date drop out."""
    day = F.col(name).cast("string")
    is_date = day.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return sizes.withColumn("_day", F.when(is_date, day.try_cast("date"))).where("_day IS NOT NULL")


def sizes_of(rows: DataFrame, name: str = "snapshot_date") -> DataFrame:
    """Rows per snapshot."""
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("row_count"))


def reported_size(reported, counted):
    """Size out of a run report when it is a whole number, else the counted size."""
    text = reported.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\s*\d+\s*$"), F.trim(text).try_cast("bigint")), counted)


def sized_by_reports(sizes: DataFrame, reports: DataFrame, name: str = "snapshot_date") -> DataFrame:
    """Sizes per snapshot, taken from the snapshot's own run report where that names a whole number.

    `reports` holds one row per snapshot with its clean_tag_row_count as text.
    """
    both = sizes.join(reports.select(name, "clean_tag_row_count"), name, "full_outer")
    size = reported_size(F.col("clean_tag_row_count"), F.col("row_count"))
    return both.select(name, size.alias("row_count")).where("row_count IS NOT NULL")


def previous_snapshots(sizes: DataFrame, name: str = "snapshot_date") -> DataFrame:
    """For each snapshot the latest strictly older one that exists, null for the oldest.

    `sizes` holds one row per snapshot, so the window runs over snapshot names only.
    """
    dated = snapshot_dates(sizes, name)
    return dated.withColumn("previous_snapshot", F.lag(name).over(Window.orderBy("_day"))).drop("_day")


def previous_snapshot(sizes: DataFrame, current: str, name: str = "snapshot_date") -> DataFrame:
    """One row: the latest snapshot strictly before `current`, null when there is none."""
    older = snapshot_dates(sizes, name).where(F.col("_day") < F.lit(current).cast("date"))
    return older.agg(F.max_by(name, "_day").alias("previous_snapshot"))


def latest_filled(sizes: DataFrame, current: str, name: str = "snapshot_date") -> DataFrame:
    """One row: the latest older snapshot that holds rows and its size, null when there is none.

    When the current name is no date, any dated snapshot but the current counts as older.
    """
    others = snapshot_dates(sizes, name).where((F.col(name) != current) & (F.col("row_count") > 0))
    limit = F.when(F.lit(current).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(current).try_cast("date"))
    older = others.where(limit.isNull() | (F.col("_day") < limit))
    return older.agg(F.max_by(name, "_day").alias("fallback_snapshot"), F.max_by("row_count", "_day").alias("fallback_row_count"))


def fallback_report(sizes: DataFrame, current: str, name: str = "snapshot_date") -> DataFrame:
    """One row: size of the current snapshot and the snapshot that should stand in when it is empty."""
    now = sizes.where(F.col(name) == current).agg(F.coalesce(F.max("row_count"), F.lit(0)).alias("current_row_count"))
    both = now.select("current_row_count", F.lit(None).cast("string").alias("fallback_snapshot"), F.lit(None).cast("bigint").alias("fallback_row_count"))
    other = latest_filled(sizes, current, name).select(F.lit(None).cast("bigint").alias("current_row_count"), "*")
    one = both.unionByName(other).agg(*[F.max(c).alias(c) for c in both.columns])
    empty = F.col("current_row_count") == 0
    return one.select(
        F.lit(current).alias("current_snapshot"), "current_row_count",
        (empty & F.col("fallback_snapshot").isNotNull()).alias("fallback_used"),
        F.when(empty, F.col("fallback_snapshot")).alias("fallback_snapshot"),
        F.when(empty, F.col("fallback_row_count")).alias("fallback_row_count"),
    )
