"""Checks that stop a run before it produces misleading figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from affinis.config import CLEAN_COLUMNS, PAIR_KEY, TEXT_COLUMNS
from affinis.functions.numbers import count_of
from affinis.functions.text import strip


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")


def repeated_keys(df: DataFrame, key: Sequence[str] = PAIR_KEY) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def require_unique(df: DataFrame, key: Sequence[str] = PAIR_KEY, what: str = "table", samples: int = 10) -> None:
    found = repeated_keys(df, key).limit(samples).collect()
    if found:
        raise ValueError(f"{what} holds several rows for one {tuple(key)}: {[tuple(r) for r in found]}")


def input_rules(df: DataFrame) -> dict[str, Column]:
    """Violation tests of an analysis input, in the order in which they are reported.

    A null count is a violation of the number rule.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    total, tag = (count_of(c, types[c]) for c in ("total_n", "tag_n"))
    rules = {f"{c}_blank": F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == "" for c in TEXT_COLUMNS}
    rules["total_n_not_numeric"] = total.isNull()
    rules["tag_n_not_numeric"] = tag.isNull()
    rules["total_n_not_positive"] = total <= 0
    rules["tag_n_negative"] = tag < 0
    rules["tag_n_above_total_n"] = tag > total
    return rules


def input_violations(df: DataFrame) -> DataFrame:
    """One row: how many rows break each rule, in one pass."""
    return df.agg(*[F.count_if(test).alias(name) for name, test in input_rules(df).items()])


def require_analysis_input(df: DataFrame) -> None:
    """Raise on missing columns, no rows, or the first broken rule with its row count."""
    require_columns(df, CLEAN_COLUMNS, "analysis input")
    counted = df.agg(F.count(F.lit(1)).alias("rows"),
                     *[F.count_if(test).alias(name) for name, test in input_rules(df).items()]).first()
    if counted["rows"] == 0:
        raise ValueError("analysis input is empty")
    for name in input_rules(df):
        if counted[name]:
            raise ValueError(f"analysis input breaks rule {name} in {counted[name]} rows")
