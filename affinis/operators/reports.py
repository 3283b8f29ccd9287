"""One-row reports out of counts over several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def count_rows() -> Column:
    return F.count(F.lit(1))


def report(parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """One row with every named aggregate of every part.

    Each part is aggregated by itself to one row of counts; the rows are then put together
    by one more aggregation, so no rows are paired with each other.
    """
    names = [n for _, aggs in parts for n in aggs]
    rows = []
    for df, aggs in parts:
        one = df.agg(*[c.cast("bigint").alias(n) for n, c in aggs.items()])
        rows.append(one.select(*[F.col(n) if n in aggs else F.lit(None).cast("bigint").alias(n) for n in names]))
    return reduce(DataFrame.unionAll, rows).agg(*[F.max(n).alias(n) for n in names])
