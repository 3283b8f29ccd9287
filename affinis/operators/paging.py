"""Global positions and pages without bringing the rows together in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from affinis.session import materialise

# monotonically_increasing_id keeps the partition above this bit and the row below it.
_ROW_BITS = 33


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2 ... in the given order, which must be total.

    The rows are range-partitioned and sorted once and stored; each position is the number
    of rows in earlier partitions plus the row's place in its own. Range bounds are sampled,
    so the sorted frame is materialised before it is read twice.
    """
    split = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = materialise(split.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_place"), _ROW_BITS)
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so neither the single-task window nor the broadcast grows with the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + row).drop("_part", "_place", "_start")


def with_page(df: DataFrame, page_size: int, position: str = "position") -> DataFrame:
    """Page number, counted from 1. A page size of 0 or less gives no pages."""
    if page_size <= 0:
        return df.withColumn("page", F.lit(None).cast("bigint")).limit(0)
    return df.withColumn("page", F.floor(F.col(position) / page_size) + 1)


def page_index(paged: DataFrame, page_size: int, folder: str = "leaderboard") -> DataFrame:
    """One row per page: the folder of its files, first row, row after the last, number of rows."""
    start = (F.col("page") - 1) * page_size
    return (
        paged.groupBy("page").agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            "page",
            F.concat(F.lit(f"{folder}/page="), F.col("page").cast("string")).alias("file"),
            start.alias("start_row"),
            (start + F.col("row_count")).alias("end_row"),
            "row_count",
        )
    )
