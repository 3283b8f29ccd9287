"""Filters, sorts and look-ups of the browsing pages, applied to whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from affinis.config import MIN_TAG_N, MIN_TOTAL_N
from affinis.functions.numbers import finite_number
from affinis.functions.text import col, compact_text, search_text
from affinis.operators.keep_first import first_per_key

# Fields that the text filters of the pages look into.
ROW_TEXT = ("entity_name", "entity_slug", "tag_name", "tag_slug")
SET_ROW_TEXT = ("entity_name", "entity_slug", "origin_set_name", "origin_set_code")
TAG_TEXT = ("tag_name", "tag_slug")
SET_TEXT = ("set_name", "set_code")
TIER_TEXT = ("entity_name", "entity_slug", "decision_tag_name")


def _bound(value) -> float | None:
    """A filter bound as typed by a user: blank or no number means no bound."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return None if number != number else number


def _plain(query: str | None) -> str:
    kept = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in (query or "").lower())
    return " ".join(kept.split())


def text_matches(columns: Sequence[str], query: str | None) -> Column:
    """Whether the query occurs in any of the columns, signs and letter case aside, with or
    without blanks. An empty query matches every row."""
    wanted = _plain(query)
    result = F.lit(not wanted)
    if wanted:
        for c in columns:
            result = result | search_text(c).contains(wanted) | compact_text(c).contains(wanted.replace(" ", ""))
    return result


def at_least(c: Column | str, minimum) -> Column:
    """Numeric lower bound; a missing value fails it, a missing bound passes all."""
    bound = _bound(minimum)
    return F.lit(True) if bound is None else F.coalesce(finite_number(c) >= bound, F.lit(False))


def at_most(c: Column | str, maximum) -> Column:
    bound = _bound(maximum)
    return F.lit(True) if bound is None else F.coalesce(finite_number(c) <= bound, F.lit(False))


def equals_if_given(c: Column | str, value: str | None) -> Column:
    return F.lit(True) if not value else F.coalesce(col(c) == value, F.lit(False))


def filter_rows(df: DataFrame, query: str | None = None, min_total_n=MIN_TOTAL_N, min_tag_n=MIN_TAG_N, min_z=None, max_z=None,
                trend_status: str | None = None, tag_query: str | None = None, text: Sequence[str] = ROW_TEXT) -> DataFrame:
    """Row filter of the leaderboard, tag and set pages."""
    test = (
        text_matches(text, query) & text_matches(TAG_TEXT, tag_query) & at_least("total_n", min_total_n)
        & at_least("tag_n", min_tag_n) & at_least("z", min_z) & at_most("z", max_z)
    )
    if trend_status:
        test = test & equals_if_given("trend_status", trend_status)
    return df.where(test)


def filter_tiers(df: DataFrame, query: str | None = None, min_total_n=MIN_TOTAL_N, min_decks=MIN_TAG_N, decks: str = "decision_tag_n",
                 tier: str | None = None) -> DataFrame:
    """Tier filter; an entity without a deciding tag fails any bound on its count."""
    return df.where(text_matches(TIER_TEXT, query) & at_least("total_n", min_total_n) & at_least(decks, min_decks)
                    & equals_if_given("bracket_key", tier))


def filter_by_substring(df: DataFrame, entity_text: str = "", tag_text: str = "", color: str = "", min_total_n=None, min_tag_n=None,
                        min_z=None, min_affinity_pct=None, trend_status: str | None = None) -> DataFrame:
    """Older filter: plain substrings, colours through their comma-joined list."""
    def includes(c: Column, needle: str) -> Column:
        wanted = needle.strip().lower()
        return F.lit(True) if not wanted else F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit("")).contains(wanted)

    types = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def first_of(*names: str, default: str = "") -> Column:
        return F.coalesce(*[F.array_join(n, ",") if types[n] == "array" else F.col(n).cast("string")
                            for n in names if n in types], F.lit(default))

    test = (
        includes(first_of("entity_name", "entity"), entity_text) & includes(first_of("tag_name", "tag"), tag_text)
        & includes(first_of("color_identity", "colour_identity", "Colour", "colour", "color", default="—"), color)
        & at_least("total_n", min_total_n) & at_least("tag_n", min_tag_n) & at_least("z", min_z)
        & at_least(display_pct(df), min_affinity_pct)
    )
    if trend_status:
        test = test & (trend_status_of(df) == trend_status)
    return df.where(test)


def display_pct(df: DataFrame) -> Column:
    """Percentage to show: its own column, else the fraction times 100, else the old column."""
    have = set(df.columns)
    parts = []
    if "tag_affinity_pct_display" in have:
        parts.append(finite_number("tag_affinity_pct_display"))
    if "tag_affinity_pct" in have:
        parts.append(finite_number("tag_affinity_pct") * 100)
    if "pct" in have:
        parts.append(finite_number("pct"))
    return F.coalesce(*parts) if parts else F.lit(None).cast("double")


def trend_status_of(df: DataFrame) -> Column:
    names = [c for c in ("snapshot_status", "trend_status", "status_type", "status") if c in df.columns]
    return F.coalesce(*names, F.lit(""))


def with_trend_fields(df: DataFrame) -> DataFrame:
    """Trend status and rank gain under their usual names, whatever names the rows bring."""
    gains = [F.nullif(F.col(c).cast("string"), F.lit("")).try_cast("double") for c in ("rank_delta", "rank_within_tag_by_z_delta") if c in df.columns]
    gain = F.coalesce(*gains) if gains else F.lit(None).cast("double")
    return df.withColumns({"trend_status": trend_status_of(df), "rank_delta": gain})


def trend_label(status: Column | str, rank_delta: Column | str) -> Column:
    """Short wording of a trend."""
    gain = finite_number(rank_delta)
    steps = F.format_string("%d", F.abs(gain).cast("bigint"))
    status = col(status)
    return (
        F.when(status == "no_previous_snapshot", "No previous snapshot yet")
        .when(status == "new_pair", "New pair")
        .when(status == "removed_pair", "Removed pair")
        .when(gain > 0, F.concat(F.lit("▲ Rank +"), steps))
        .when(gain < 0, F.concat(F.lit("▼ Rank -"), steps))
        .when(status == "existing", "Existing")
        .otherwise("Trend unavailable")
    )


def sort_keys(df: DataFrame, key: str, descending: bool = True, ties: Sequence[str] = ()) -> list[Column]:
    """User sort by any column: numbers by size with a missing number as the greatest, then texts."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    numeric = types[key] in ("byte", "short", "integer", "long", "float", "double", "decimal")
    number = F.col(key) if numeric else F.col(key).cast("string").try_cast("double")
    keys = [number.desc_nulls_first() if descending else number.asc_nulls_last()]
    if not numeric:
        text = F.coalesce(F.col(key).cast("string"), F.lit(""))
        keys.append(text.desc() if descending else text.asc())
    return [*keys, *[F.col(c) for c in ties]]


def sort_rows(df: DataFrame, key: str | None, descending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*sort_keys(df, key, descending, ties)) if key else df


def search_entities(df: DataFrame, query: str | None, fields: Sequence[str] = ("entity_name",)) -> DataFrame:
    """Entities whose name holds the query, most popular first."""
    wanted = (query or "").strip().lower()
    found = df
    if wanted:
        test = F.lit(False)
        for c in fields:
            test = test | F.coalesce(F.lower(F.col(c)), F.lit("")).contains(wanted)
        found = df.where(test)
    return found.orderBy(F.coalesce("total_n", F.lit(0)).desc(), "entity_slug")


def window_of(df: DataFrame, size: int, start: int = 0) -> DataFrame:
    """A visible stretch of an ordered frame; the limit is the feature."""
    return df.offset(start).limit(size)


def best_tags(df: DataFrame, limit: int = 5) -> DataFrame:
    """Strongest tags of each entity. The rank bound is applied before the shuffle as well."""
    order = Window.partitionBy("entity_slug").orderBy(
        F.coalesce(F.col("z"), F.lit(float("-inf"))).desc(), F.coalesce(F.col("tag_n"), F.lit(0)).desc(), "tag_slug")
    return df.withColumn("tag_rank", F.row_number().over(order)).where(F.col("tag_rank") <= limit)


def highlights(df: DataFrame) -> DataFrame:
    """Strongest and largest tag of each entity, among the tags that have the figure."""
    def tag(value: str) -> Column:
        return F.min_by(F.struct("tag_slug", "tag_name", value), F.when(F.col(value).isNotNull(), F.struct(-F.col(value), F.col("tag_slug"))))

    return df.groupBy("entity_slug").agg(tag("z").alias("strongest_tag"), tag("tag_n").alias("largest_tag"))


def top_values(df: DataFrame, value: str, limit: int = 10, digits: int | None = None) -> DataFrame:
    """Bars of a chart: the rows with the greatest value; the limit is the feature."""
    number = finite_number(value)
    shown = F.round(number, digits) if digits is not None else F.col(value)
    named = F.coalesce("entity_name", F.lit("Unknown")).alias("name")
    top = df.where(number.isNotNull()).orderBy(number.desc(), "entity_slug", "tag_slug").limit(limit)
    return top.select(named, "entity_slug", "tag_slug", shown.alias("value"))


def tag_options(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Tags to choose from: each slug once with the name in its first row, by name."""
    slug = F.coalesce("tag_slug", "tag_name")
    rows = df.select(slug.alias("slug"), F.coalesce("tag_name", slug).alias("name"), *order).where(F.coalesce("slug", F.lit("")) != "")
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return rows.groupBy("slug").agg(F.min_by("name", place).alias("name")).orderBy("name", "slug")


def tag_options_of_summary(summary: DataFrame) -> DataFrame:
    names = set(summary.columns)
    slug = F.coalesce(*[F.col(c) for c in ("tag_slug", "slug", "tag_name") if c in names])
    name = F.coalesce(*[F.col(c) for c in ("tag_name", "name", "tag_slug") if c in names], F.lit("Unknown tag"))
    return summary.select(slug.alias("slug"), name.alias("name")).where(F.coalesce("slug", F.lit("")) != "").orderBy("name", "slug")


def find_tag(summary: DataFrame, wanted: str) -> DataFrame:
    """The first summary row whose slug, other slug or name is the wanted text."""
    test = F.lit(False)
    for c in ("tag_slug", "slug", "tag_name"):
        if c in summary.columns:
            test = test | F.coalesce(F.col(c) == wanted, F.lit(False))
    return summary.where(test).orderBy("tag_slug").limit(1)


def summary_card(summary: DataFrame) -> DataFrame:
    """Summary figures under one set of names, whatever names the rows bring."""
    aliases = {
        "row_count": ("row_count", "tag_row_count", "total_row_count"),
        "eligible_count": ("analysis_eligible_row_count", "eligible_row_count"),
        "mean_pct": ("tag_mean_pct", "mean_pct", "avg_affinity_pct"),
        "std_pct": ("tag_std_pct", "std_pct", "affinity_std_pct"),
        "max_z": ("max_z", "max_z_score", "highest_z"),
    }
    have = set(summary.columns)

    def number(names: Sequence[str]) -> Column:
        found = [finite_number(c) for c in names if c in have]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    keys = [c for c in ("tag_slug", "tag_name") if c in have]
    return summary.select(*keys, *[number(names).alias(n) for n, names in aliases.items()])


def entity_index(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First row of each entity with the given columns it has, by name."""
    kept = [c for c in columns if c in df.columns]
    first = first_per_key(df.select(*kept, *[c for c in order if c not in kept]), ["entity_slug"], order)
    return first.select(*kept).orderBy(F.col("entity_name").asc_nulls_last(), "entity_slug")


def tag_index(df: DataFrame, summary: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """The tag summary by name, or the tags of the rows when there is no summary."""
    if summary is not None:
        return summary.orderBy(F.col("tag_name").asc_nulls_last(), "tag_slug")
    options = tag_options(df, order)
    return options.select(F.col("slug").alias("tag_slug"), F.col("name").alias("tag_name"))
