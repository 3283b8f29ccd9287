"""Ranks inside groups that stay even when one group holds a large share of all rows.

A window over a group would sort the whole group in one task. Instead the rows are reduced
to a table of distinct values with counts, and the values are cut into slots by an
order-preserving function of the value alone. Running counts are then taken per
(group, slot) and per slot, so that no task ever holds a group, and joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from affinis.functions.text import col

_GREATEST = 1.7e308
# Slots per doubling of the value.
SLOTS_PER_OCTAVE = 256


def value_slot(value: Column | str, per_octave: int = SLOTS_PER_OCTAVE) -> Column:
    """Slot number that never falls as the value grows; about 0.3 % of the value wide."""
    v = col(value).cast("double")
    size = F.floor((F.log2(F.least(F.abs(v), F.lit(_GREATEST))) + 1100) * per_octave)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("bigint") * size)


def value_ranks(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row per (group, value) that is a number:

    n_equal    rows with the value
    n_group    rows of the group with any value
    rank_desc  lowest rank, the greatest value first
    rank_asc   average rank, the smallest value first
    """
    present = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(group).isNotNull()
    counts = rows.where(present).groupBy(group, value).agg(F.count(F.lit(1)).alias("n_equal"))
    counts = counts.withColumn("_slot", value_slot(value))
    per_slot = counts.groupBy(group, "_slot").agg(F.sum("n_equal").alias("_n"))
    by_group = Window.partitionBy(group)
    per_slot = per_slot.select(
        group, "_slot",
        F.coalesce(F.sum("_n").over(by_group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_slots_below"),
        F.sum("_n").over(by_group).alias("n_group"),
    )
    in_slot = Window.partitionBy(group, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_slots_below") + F.col("_values_below")
    return (
        counts.withColumn("_values_below", F.coalesce(F.sum("n_equal").over(in_slot), F.lit(0)))
        .join(per_slot, [group, "_slot"])
        .select(
            group, value, "n_equal", "n_group",
            (F.col("n_group") - below - F.col("n_equal") + 1).cast("bigint").alias("rank_desc"),
            (below + (F.col("n_equal") + 1) / 2).alias("rank_asc"),
        )
    )


def window_ranks(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The same table by plain windows, for groups known to fit a task."""
    present = rows.where(F.col(value).isNotNull()).select(group, value)
    by_group = Window.partitionBy(group)
    ties = F.count(F.lit(1)).over(Window.partitionBy(group, value))
    return present.select(
        group, value,
        ties.alias("n_equal"),
        F.count(F.lit(1)).over(by_group).alias("n_group"),
        F.rank().over(by_group.orderBy(F.col(value).desc())).alias("rank_desc"),
        (F.rank().over(by_group.orderBy(value)) + (ties - 1) / 2).alias("rank_asc"),
    ).distinct()
