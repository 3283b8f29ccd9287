"""Rows of older or merged files under the usual column names, and entities rolled up from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from affinis.functions.colors import loose_colors
from affinis.functions.lists import display_list
from affinis.functions.numbers import finite_number
from affinis.functions.text import empty_to_null, unique_texts
from affinis.operators.explore import best_tags
from affinis.operators.keep_first import ordinal

# Other columns a missing column is taken from, first one the table has.
COLUMN_FALLBACKS = {
    "total_n": ("total_n_current", "total_n_x"),
    "tag_n": ("tag_n_current", "tag_n_x"),
    "tag_affinity_pct": ("affinity_pct_current", "tag_affinity_pct_x"),
    "z": ("z_current", "z_x"),
    "rank_within_tag_by_z": ("rank_within_tag_by_z_current", "rank_within_tag_by_z_x"),
}
# Columns a value is taken from row by row, first one that is filled.
ROW_ALIASES = {
    "entity_name": ("entity_name", "entity"),
    "tag_name": ("tag_name", "tag"),
    "total_n": ("total_n_current", "total_n", "total_n_x", "total_n_y"),
    "tag_n": ("tag_n_current", "tag_n", "tag_n_x", "tag_n_y"),
    "z": ("z_current", "z", "z_x", "z_y"),
    "rank_within_tag_by_z": ("rank_within_tag_by_z_current", "rank_within_tag_by_z", "rank_within_tag_by_z_x",
                             "rank_within_tag_by_z_y", "rank_within_tag"),
    "card_uri": ("card_uri", "entity_card_uri"),
    "trend_status": ("snapshot_status", "trend_status", "status_type"),
    "rank_delta": ("rank_delta", "rank_within_tag_by_z_delta"),
}
PCT_ALIASES = ("affinity_pct_current", "tag_affinity_pct", "tag_affinity_pct_x", "tag_affinity_pct_y", "pct")
COLOR_ALIASES = ("color_identity", "card_color_identity", "Colour", "colour", "color")
IMAGE_ALIASES = ("card_image_url", "image_url", "entity_image_url")
LIST_ALIASES = {
    "partner_card_image_urls": ("partner_card_image_urls", "partner_image_urls", "card_image_urls"),
    "partner_card_uris": ("partner_card_uris", "card_uris"),
    "card_names": ("card_names", "partner_card_names"),
}


def fill_columns(df: DataFrame) -> DataFrame:
    """Columns the table lacks, taken from the first other column it has; percentage derived."""
    have = set(df.columns)
    added = {}
    for target, others in COLUMN_FALLBACKS.items():
        source = next((c for c in others if c in have), None)
        if target not in have and source:
            added[target] = F.col(source)
    result = df.withColumns(added) if added else df
    if "tag_affinity_pct_display" not in result.columns and "tag_affinity_pct" in result.columns:
        result = result.withColumn("tag_affinity_pct_display", F.col("tag_affinity_pct") * 100)
    return result


def _first_filled(df: DataFrame, names: Sequence[str]) -> Column | None:
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    parts = [empty_to_null(c) if types[c] == "string" else F.col(c) for c in names if c in types]
    return F.coalesce(*parts) if parts else None


def usual_rows(df: DataFrame) -> DataFrame:
    """Rows with every usual column filled from whichever alias holds a value."""
    types = {f.name: f.dataType for f in df.schema.fields}
    made = {name: c for name, names in ROW_ALIASES.items() if (c := _first_filled(df, names)) is not None}

    pct = _first_filled(df, PCT_ALIASES)
    parts = [finite_number(pct)] if pct is not None else []
    if "tag_affinity_pct_display" in types:
        parts.append(finite_number("tag_affinity_pct_display") / 100)
    if parts:
        made["tag_affinity_pct"] = F.coalesce(*parts)

    colors = [F.when(F.size(c) >= 0, F.col(c)) if types[c].typeName() == "array" else loose_colors(c) for c in COLOR_ALIASES if c in types]
    if colors:
        made["color_identity"] = F.coalesce(*colors)

    lists = {}
    for name, names in LIST_ALIASES.items():
        found = [display_list(c, types[c]) for c in names if c in types]
        lists[name] = unique_texts(F.concat(*found)) if found else F.array().cast("array<string>")
    image = _first_filled(df, IMAGE_ALIASES)
    first_image = F.get(lists["partner_card_image_urls"], F.lit(0))
    made["card_image_url"] = F.coalesce(image, first_image) if image is not None else first_image
    own = unique_texts(F.array(made["card_image_url"]))
    made |= lists
    made["partner_card_image_urls"] = F.when(F.size(lists["partner_card_image_urls"]) > 0, lists["partner_card_image_urls"]).otherwise(own)
    return df.select(*[c for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def roll_up(rows: DataFrame, order: Sequence[str], tags: int = 5) -> DataFrame:
    """One row per entity: greatest total, first filled images, colours and addresses, first list
    of more than one item (else the first list), best rank gain, strongest tags; by popularity.

    `rows` are usual rows. Only the strongest tags of an entity are ever collected.
    """
    place = ordinal(order)
    have = {f.name: f.dataType.typeName() for f in rows.schema.fields}

    def first(name: str, filled: Column) -> Column:
        return F.min_by(name, F.when(filled, place))

    aggs = [F.coalesce(empty_to_null(F.min_by("entity_name", place)), F.col("entity_slug")).alias("entity_name"),
            F.max(F.coalesce("total_n", F.lit(0))).alias("total_n")]
    for c in ("card_image_url", "card_uri", "trend_status"):
        if c in have:
            aggs.append(first(c, F.coalesce(F.col(c), F.lit("")) != "").alias(c))
    if "color_identity" in have:
        aggs.append(first("color_identity", F.col("color_identity").isNotNull()).alias("color_identity"))
    for c in LIST_ALIASES:
        if c in have:
            aggs.append(F.coalesce(first(c, F.size(c) > 1), F.min_by(c, place)).alias(c))
    if "rank_delta" in have:
        aggs.append(F.max(finite_number("rank_delta")).alias("best_rank_delta"))
    named = rows.where(F.coalesce("entity_slug", F.lit("")) != "")
    grouped = named.groupBy("entity_slug").agg(*aggs)
    top = best_tags(named, tags).groupBy("entity_slug").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tag_rank", "tag_slug", "tag_name", "z", "tag_n"))),
                    lambda t: F.struct(t["tag_slug"].alias("tag_slug"), t["tag_name"].alias("tag_name"), t["z"].alias("z"), t["tag_n"].alias("tag_n"))).alias("top_tags"))
    return grouped.join(top, "entity_slug", "left").orderBy(F.col("total_n").desc(), "entity_slug")
