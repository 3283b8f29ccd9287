"""Signal pages: one row per entity with the signal tag, one status per attempt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from affinis.config import CLEAN_COLUMNS, SIGNAL_NAME, SIGNAL_SLUG, SIGNAL_SOURCE
from affinis.functions import payload as pl
from affinis.functions.numbers import count_of
from affinis.functions.text import blank_to_null, name_from_slug, strip
from affinis.operators.keep_first import first_per_key
from affinis.operators.reports import count_rows, report

# Statuses of an attempt.
WRITTEN = "cedh_row_written"
NO_ROUTE, NO_ROWS = "no_cedh_route", "no_cedh_decks"
NO_METADATA, NO_SLUG = "missing_normal_metadata", "invalid_commander_index_record"
HTTP_ERROR, REQUEST_ERROR, PARSE_ERROR = "http_error", "request_error", "parse_error"
REASONS = {
    WRITTEN: "row made from the count of the filtered page",
    NO_ROUTE: "the filtered page does not exist (404)",
    NO_ROWS: "the count of the filtered page is zero",
    NO_METADATA: "no normal tag row gives the total count",
    NO_SLUG: "index record without a slug",
    HTTP_ERROR: "the page answered with an error",
    REQUEST_ERROR: "the page could not be fetched",
    PARSE_ERROR: "the page could not be read as a signal row",
}


def normal_metadata(normal: DataFrame, order: Sequence[str]) -> DataFrame:
    """Name and total count of each entity from its first normal tag row."""
    types = {f.name: f.dataType for f in normal.schema.fields}
    rows = normal.select(
        strip(F.col("entity_slug").cast("string")).alias("entity_slug"),
        F.coalesce(blank_to_null("entity_name"), name_from_slug(strip("entity_slug"))).alias("entity_name"),
        count_of("total_n", types["total_n"]).alias("total_n"), *order,
    ).where("entity_slug <> ''")
    return first_per_key(rows, ["entity_slug"], order).select(
        "entity_slug", "entity_name", "total_n", F.lit(True).alias("_normal"))


def classify_responses(index: DataFrame, metadata: DataFrame, responses: DataFrame, observed_at: Column) -> DataFrame:
    """One row per index record with its status and, for a good page, the counts.

    `responses` holds entity_slug, http_status, transport_error and body. Of several responses of an entity the one with the least status stands for it,
    one without a status last, then the least error and body.
    """
    asked = index.select(strip(F.coalesce("entity_slug", F.lit(""))).alias("entity_slug"))
    place = F.struct(F.col("http_status").isNull().alias("none"), "http_status", "transport_error", "body")
    one_each = responses.groupBy("entity_slug").agg(F.min(place).alias("_r")).select("entity_slug", "_r.http_status", "_r.transport_error", "_r.body")
    joined = asked.join(metadata, "entity_slug", "left").join(one_each, "entity_slug", "left")
    read = joined.withColumn("_n", pl.page_count(F.try_parse_json("body")))
    n = F.col("_n")
    http = F.col("http_status")
    status = (
        F.when(F.col("entity_slug") == "", NO_SLUG)
        .when(F.col("_normal").isNull(), NO_METADATA)
        .when(http == 404, NO_ROUTE)
        .when(http >= 400, HTTP_ERROR)
        .when(F.col("transport_error").isNotNull() | http.isNull(), REQUEST_ERROR)
        .when(F.coalesce(F.col("total_n"), F.lit(0)) <= 0, PARSE_ERROR)
        .when(n.isNull(), PARSE_ERROR)
        .when(n <= 0, NO_ROWS)
        .when(n > F.col("total_n"), PARSE_ERROR)
        .otherwise(WRITTEN)
    )
    return read.select(
        "entity_slug", "entity_name", "total_n", status.alias("status_type"),
        F.when(status.isin(NO_ROUTE, HTTP_ERROR), http).alias("http_status_code"),
        F.when(status == WRITTEN, n).alias("tag_n"), observed_at.alias("observed_at"),
    )


def signal_rows(outcome: DataFrame) -> DataFrame:
    """Clean-shaped rows of the good pages."""
    return outcome.where(F.col("status_type") == WRITTEN).select(
        "entity_name", "entity_slug", "total_n", F.lit(SIGNAL_NAME).alias("tag_name"), F.lit(SIGNAL_SLUG).alias("tag_slug"),
        "tag_n", F.lit(SIGNAL_SOURCE).alias("source_type"), "observed_at",
    ).select(*CLEAN_COLUMNS)


def status_rows(outcome: DataFrame, url: Column) -> DataFrame:
    """Status table of all attempts."""
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return outcome.select(
        "entity_slug", F.when(F.col("entity_slug") != "", url).alias("url"), "status_type",
        reasons[F.col("status_type")].alias("reason"), "observed_at", "http_status_code", "tag_n")


def signal_summary(index: DataFrame, done: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row of figures on a signal run; `outcome` covers the pending entities."""
    status = F.col("status_type")
    return report([
        (index, {"total_records_in_index": count_rows()}),
        (index.join(done, "entity_slug", "left_semi"), {"skipped_count": count_rows()}),
        (outcome, {
            "attempted_count": F.count_if(status != NO_SLUG),
            "signal_row_count": F.count_if(status == WRITTEN),
            "no_signal_count": F.count_if(status.isin(NO_ROUTE, NO_ROWS)),
            "missing_metadata_count": F.count_if(status == NO_METADATA),
            "error_count": F.count_if(status.isin(NO_SLUG, HTTP_ERROR, REQUEST_ERROR, PARSE_ERROR)),
        }),
    ])
