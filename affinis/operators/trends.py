"""Comparison of two snapshots of the affinity table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from affinis.config import PAIR_KEY
from affinis.functions.numbers import finite_number, ratio
from affinis.operators.checks import require_columns, require_unique
from affinis.operators.reports import count_rows, report

# Identity columns, compared metrics with their names in a trend row, statuses.
IDENTITY = ("entity_name", "entity_slug", "tag_name", "tag_slug", "source_type")
METRICS = {
    "total_n": "total_n",
    "tag_n": "tag_n",
    "tag_affinity_pct": "affinity_pct",
    "z": "z",
    "rank_within_tag_by_z": "rank_within_tag_by_z",
}
COUNT_METRICS = ("total_n", "tag_n")
EXISTING, NEW, REMOVED, FIRST_RUN = "existing", "new_pair", "removed_pair", "no_previous_snapshot"
STATUSES = (EXISTING, NEW, REMOVED, FIRST_RUN)


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that the frame has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def comparison_columns(df: DataFrame) -> DataFrame:
    """Identity and metric columns the frame has; metrics that are texts are read as numbers."""
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.select(*[
        finite_number(c).alias(c) if c in METRICS and c in texts else F.col(c)
        for c in available(df, (*IDENTITY, *METRICS))
    ])


def snapshot_rows(df: DataFrame, what: str, check: bool = True) -> DataFrame:
    """Rows of one snapshot fit for comparison: keys present and unique."""
    require_columns(df, PAIR_KEY, what)
    if check:
        require_unique(df, PAIR_KEY, what)
    return df


def trends(current: DataFrame, previous: DataFrame | None, current_name: str, previous_name: str | None,
           check: bool = True) -> DataFrame:
    """One row per (entity, tag) of either snapshot: status, values of both, differences.

    Differences are current minus previous, except for ranks, where a gain is positive.
    """
    cur = comparison_columns(snapshot_rows(current, "current snapshot", check))
    if previous is None:
        return first_run(cur, current_name)
    prev = comparison_columns(snapshot_rows(previous, "previous snapshot", check))
    both = _marked(cur, "current").join(_marked(prev, "previous"), list(PAIR_KEY), "full_outer")
    identity = [
        F.coalesce(*[F.col(f"{c}_{s}") for s in ("current", "previous") if f"{c}_{s}" in both.columns]).alias(c)
        for c in IDENTITY if c not in PAIR_KEY and (c in cur.columns or c in prev.columns)
    ]
    return both.select(*PAIR_KEY, *identity, *_compared(both.columns, current_name, previous_name))


def _compared(columns: Sequence[str], current_name: str, previous_name: str | None) -> list[Column]:
    """Trend columns of a joined row of two snapshots."""
    def side(column: str, name: str) -> Column:
        full = f"{column}_{name}"
        return F.col(full) if full in columns else F.lit(None).cast("double")

    status = F.when(F.col("_in_previous").isNull(), NEW).when(F.col("_in_current").isNull(), REMOVED).otherwise(EXISTING)
    values = []
    for source, name in METRICS.items():
        now, before = side(source, "current"), side(source, "previous")
        change = before - now if name == "rank_within_tag_by_z" else now - before
        values += [now.alias(f"{name}_current"), before.alias(f"{name}_previous"), change.alias(f"{name}_delta")]
    changes = [ratio(side(c, "current") - side(c, "previous"), side(c, "previous")).alias(f"{c}_pct_change") for c in COUNT_METRICS]
    ranks = side("rank_within_tag_by_z", "previous") - side("rank_within_tag_by_z", "current")
    return [F.lit(current_name).alias("current_snapshot"), F.lit(previous_name).alias("previous_snapshot"), status.alias("snapshot_status"),
            *values, *changes, ranks.alias("rank_delta")]


def attach_previous(current: DataFrame, previous: DataFrame | None, current_name: str, previous_name: str | None, check: bool = True) -> DataFrame:
    """attach_trends() without trend rows in between: current rows and their trend columns from one left join with the previous snapshot. Where both
    are dealt by pair key (see sources/snapshots.py), nothing is shuffled."""
    current = snapshot_rows(current, "current snapshot", check)
    cur = comparison_columns(current)
    if previous is None:
        return attach_trends(current, first_run(cur, current_name))
    prev = _marked(comparison_columns(snapshot_rows(previous, "previous snapshot", check)), "previous")
    texts = {f.name for f in current.schema.fields if f.dataType.typeName() == "string"}
    metrics = [finite_number(c).alias(f"{c}_current") if c in texts else F.col(c).alias(f"{c}_current") for c in cur.columns if c in METRICS]
    marked = current.select(*PAIR_KEY, F.struct(*[c for c in current.columns if c not in PAIR_KEY]).alias("_row"), *metrics, F.lit(True).alias("_in_current"))
    both = marked.join(prev, list(PAIR_KEY), "left")
    kept = [F.col(c) if c in PAIR_KEY else F.col("_row")[c].alias(c) for c in current.columns]
    return both.select(*kept, *_compared(both.columns, current_name, previous_name))


def _marked(df: DataFrame, name: str) -> DataFrame:
    """The frame with its columns named after the snapshot and a presence marker."""
    renamed = df.select(*[F.col(c) if c in PAIR_KEY else F.col(c).alias(f"{c}_{name}") for c in df.columns])
    return renamed.withColumn(f"_in_{name}", F.lit(True))


def first_run(current: DataFrame, current_name: str) -> DataFrame:
    """Trend rows when there is nothing to compare with."""
    types = {f.name: f.dataType.simpleString() for f in current.schema.fields}
    values = []
    for source, name in METRICS.items():
        kind = types.get(source, "double")
        now = F.col(source) if source in types else F.lit(None).cast(kind)
        missing = F.lit(None).cast(kind)
        values += [now.alias(f"{name}_current"), missing.alias(f"{name}_previous"), missing.alias(f"{name}_delta")]
    nothing = F.lit(None).cast("double")
    identity = [c for c in IDENTITY if c not in PAIR_KEY and c in types]
    return current.select(
        *PAIR_KEY, *identity,
        F.lit(current_name).alias("current_snapshot"), F.lit(None).cast("string").alias("previous_snapshot"),
        F.lit(FIRST_RUN).alias("snapshot_status"), *values,
        *[nothing.alias(f"{c}_pct_change") for c in COUNT_METRICS],
    ).withColumn("rank_delta", F.col("rank_within_tag_by_z_delta"))


def attach_trends(current: DataFrame, trend_rows: DataFrame) -> DataFrame:
    """Current rows with their trend columns; removed pairs have no current row and drop out."""
    kept = [c for c in trend_rows.columns if c in PAIR_KEY or c not in IDENTITY]
    live = trend_rows.where(F.col("snapshot_status") != REMOVED).select(*kept)
    return current.join(live, list(PAIR_KEY), "left")


def trend_summary(trend_rows: DataFrame, current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """One row: sizes, rows per status, rows with each difference."""
    status = F.col("snapshot_status")
    counts = {"trend_row_count": count_rows()}
    counts |= {f"{s}_count" if s == FIRST_RUN else f"{s.removesuffix('_pair')}_pair_count": F.count_if(status == s)
               for s in STATUSES}
    counts |= {f"rows_with_{n}_delta": F.count(f"{n}_delta") for n in ("total_n", "tag_n", "affinity_pct", "z")}
    counts["rows_with_rank_delta"] = F.count("rank_delta")
    parts = [(trend_rows, counts), (current, {"current_row_count": count_rows()})]
    if previous is not None:
        parts.append((previous, {"previous_row_count": count_rows()}))
        return report(parts)
    return report(parts).withColumn("previous_row_count", F.lit(0).cast("bigint"))
