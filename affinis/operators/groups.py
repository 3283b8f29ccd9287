"""Origin sets: rows per set, set index, entities of a set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from affinis.functions.origin_sets import FLAT_COLUMNS, belongs_to_set, selected_set, sets_of_row
from affinis.functions.text import blank_to_null, empty_to_null, safe_slug
from affinis.operators.keep_first import best_per_key, ordinal
from affinis.operators.reports import count_rows

# Columns of a row published under a set, before the five set columns.
SET_ROW_COLUMNS = (
    "entity_name", "entity_slug", "tag_name", "tag_slug", "color_identity", "total_n", "tag_n",
    "tag_affinity_pct", "tag_affinity_pct_display", "z", "rank_within_tag_by_z", "rank_delta", "z_delta",
    "tag_n_delta", "trend_status", "card_image_url", "partner_card_image_urls", "card_uri",
    "partner_card_uris", "card_names",
)
TAG_METRICS = ("tag_name", "tag_slug", "z", "tag_n", "tag_affinity_pct")


def with_origin_sets(df: DataFrame, *, slug_code: bool = True) -> DataFrame:
    """Rows with the normal list of their origin sets; flat set columns follow the first set
    where there is one and stay as they are elsewhere."""
    staged = df.withColumn("_sets", sets_of_row(df, slug_code=slug_code))
    first = F.get("_sets", F.lit(0))
    for field, name in FLAT_COLUMNS.items():
        old = F.col(name) if name in df.columns else F.lit(None).cast("string")
        staged = staged.withColumn(name, F.when(first.isNotNull(), first[field]).otherwise(old))
    return staged.withColumn("origin_sets", F.col("_sets")).drop("_sets")


def set_rows(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per row and origin set, the set columns taken from that set.

    `set_place` orders the rows of the result as the input rows and their sets stand.
    """
    exploded = df.withColumn("_sets", sets_of_row(df)).select("*", F.posexplode("_sets").alias("_pos", "_set"))
    status = [blank_to_null(c) for c in ("trend_status", "snapshot_status") if c in df.columns]
    columns = [
        F.coalesce(*status).alias(c) if c == "trend_status" and status
        else F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
        for c in SET_ROW_COLUMNS
    ]
    from_set = [F.col("_set")[field].alias(name) for field, name in FLAT_COLUMNS.items()]
    place = [F.struct(*order, "_pos").alias("set_place")] if order else []
    return exploded.select(*columns, *from_set, F.col("_sets").alias("origin_sets"), *place)


def in_set_order(rows: DataFrame) -> DataFrame:
    """Strongest rows first, rows without a z-score last."""
    return rows.orderBy(
        "origin_set_code", F.col("z").desc_nulls_last(), F.coalesce("entity_name", F.lit("")),
        F.coalesce("tag_name", F.lit("")), "entity_slug", "tag_slug")


def _index(rows: DataFrame, place: Column, counts: dict[str, Column]) -> DataFrame:
    def first_filled(name: str) -> Column:
        return F.min_by(name, F.when(F.coalesce(blank_to_null(name), F.lit("")) != "", place))

    return rows.groupBy(F.col("origin_set_code").alias("set_code")).agg(
        F.min_by("origin_set_name", place).alias("set_name"),
        first_filled("origin_released_at").alias("released_at"),
        first_filled("set_page_uri").alias("set_page_uri"),
        F.min_by("set_uri", place).alias("set_uri"),
        *[c.alias(n) for n, c in counts.items()],
    ).withColumn("set_name", F.coalesce(empty_to_null("set_name"), F.upper("set_code"))).withColumn(
        "file", F.concat(F.lit("sets/shard="), safe_slug("set_code")))


def set_index(rows: DataFrame) -> DataFrame:
    """One row per set out of set rows: name of the first row, first date and address there
    are, entities and rows; latest sets first."""
    counts = {"entity_count": F.countDistinct(blank_to_null("entity_slug")), "row_count": count_rows()}
    return _index(rows, F.col("set_place"), counts).orderBy(
        F.coalesce("released_at", F.lit("")).desc(), F.coalesce("set_name", F.lit("")).desc(), "set_code")


def set_index_of_entities(entities: DataFrame, order: Sequence[str]) -> DataFrame:
    """The same index when only entity rows are at hand; it counts entity rows."""
    staged = entities.select(
        F.posexplode(sets_of_row(entities, slug_code=False)).alias("_pos", "_set"), ordinal(order).alias("_row"))
    rows = staged.select(
        F.struct("_row", "_pos").alias("_place"), *[F.col("_set")[f].alias(n) for f, n in FLAT_COLUMNS.items()])
    return _index(rows, F.col("_place"), {"entity_count": count_rows()}).orderBy(
        F.coalesce("released_at", F.lit("")).desc(), F.coalesce("set_name", F.lit("")), "set_code")


def entities_of_set(entities: DataFrame, code: str) -> DataFrame:
    """Entities of a set, their flat set columns taken from that set."""
    staged = entities.withColumn("_sets", sets_of_row(entities, slug_code=False)).where(belongs_to_set("_sets", code))
    chosen = selected_set("_sets", code)
    wanted = safe_slug(F.lit(code))
    return (
        staged.withColumn("origin_set_code", F.coalesce(chosen["set_code"], wanted))
        .withColumn("origin_set_name", F.coalesce(chosen["set_name"], F.upper(wanted)))
        .withColumn("origin_released_at", chosen["released_at"])
        .drop("_sets")
    )


def has_tag_metrics(df: DataFrame) -> Column:
    """Whether a row carries any figure of a tag."""
    parts = [empty_to_null(F.col(c).cast("string")) for c in TAG_METRICS if c in df.columns]
    return F.coalesce(*parts).isNotNull() if parts else F.lit(False)


def expand_set_rows(base: DataFrame, details: DataFrame, code: str, order: Sequence[str], *, keep_unexpanded: bool) -> DataFrame:
    """Rows of a set that carry no tag figures, replaced by the detail rows of their entities.

    Set columns come from the base row's own set where it has it. With `keep_unexpanded` an
    entity without details keeps its base row and every base row expands; without it the
    last base row of an entity counts, and base rows come back only when nothing expands.
    """
    if base.isEmpty() or not base.where(has_tag_metrics(base)).isEmpty():
        return base
    chosen = F.get(F.filter("_sets", lambda s: s["set_code"] == code.lower()), F.lit(0))
    origin = base.withColumn("_sets", sets_of_row(base, slug_code=False)).withColumn("_origin", chosen).drop("_sets")
    slugged = F.coalesce("entity_slug", F.lit("")) != ""
    overridden = ("set_code", "set_name", "released_at") if keep_unexpanded else tuple(FLAT_COLUMNS)
    if keep_unexpanded:
        owners = origin.select("entity_slug", "_origin").where(slugged)
        joined = details.join(owners, "entity_slug")
    else:
        owners = best_per_key(origin.where(slugged).select("entity_slug", "_origin", *order), ["entity_slug"], ordinal(order))
        joined = details.join(owners.select("entity_slug", "_origin"), "entity_slug").where(
            F.col("_origin").isNotNull() | belongs_to_set(sets_of_row(details, slug_code=False), code))
    expanded = joined
    for field in overridden:
        name = FLAT_COLUMNS[field]
        old = F.col(name) if name in details.columns else F.lit(None).cast("string")
        expanded = expanded.withColumn(name, F.coalesce(empty_to_null(F.col("_origin")[field]), old))
    expanded = expanded.drop("_origin")
    if keep_unexpanded:
        left = base.where(~slugged).unionByName(
            base.where(slugged).join(details.select("entity_slug").distinct(), "entity_slug", "left_anti"))
        return expanded.unionByName(left, allowMissingColumns=True)
    return expanded if not expanded.isEmpty() else base
