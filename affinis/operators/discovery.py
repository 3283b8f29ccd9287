"""Entity index out of page addresses, its report, and what is left to do of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from affinis.functions.text import blank_to_null
from affinis.functions.urls import slug_from_url
from affinis.operators.keep_first import first_per_key, ordinal
from affinis.operators.reports import count_rows, report

# Fixed value: source name of index rows that come from a sitemap.
INDEX_SOURCE = "commanders_sitemap"


def with_slug(urls: DataFrame, url: str, hosts: Sequence[str], prefix: str) -> DataFrame:
    return urls.withColumn("entity_slug", slug_from_url(url, hosts, prefix))


def index_rows(slugged: DataFrame, url: str, discovered_at: Column, order: Sequence[str]) -> DataFrame:
    """Index rows of the valid addresses, repeated slugs included."""
    return slugged.where("entity_slug IS NOT NULL").select(
        "entity_slug", F.col(url).alias("entity_url"), F.lit(INDEX_SOURCE).alias("source_type"),
        discovered_at.alias("discovered_at"), ordinal(order).alias("place"))


def dedupe_index(rows: DataFrame) -> DataFrame:
    """First row of each slug."""
    return first_per_key(rows, ["entity_slug"], ["place"])


def invalid_urls(slugged: DataFrame, url: str) -> DataFrame:
    return slugged.where("entity_slug IS NULL").select(url)


def duplicate_slugs(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy("entity_slug").agg(count_rows().alias("row_count"))
    return counted.where("row_count > 1").orderBy("entity_slug")


def index_report(slugged: DataFrame) -> DataFrame:
    """One row: locations, rows before and after de-duplication, duplicates, invalid addresses."""
    per_slug = slugged.groupBy("entity_slug").agg(count_rows().alias("n"))
    slug = F.col("entity_slug")
    return per_slug.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_locations_found"),
        F.coalesce(F.sum(F.when(slug.isNotNull(), F.col("n"))), F.lit(0)).alias("records_before_deduplication"),
        F.count("entity_slug").alias("records_after_deduplication"),
        F.count("entity_slug").alias("unique_slugs"),
        F.count_if(slug.isNotNull() & (F.col("n") > 1)).alias("duplicate_slug_count"),
        F.coalesce(F.sum(F.when(slug.isNull(), F.col("n"))), F.lit(0)).alias("invalid_url_count"),
        F.coalesce(F.sum(F.when(slug == "", F.col("n"))), F.lit(0)).alias("missing_slug_count"),
    )


def done_slugs(*tables: DataFrame) -> DataFrame:
    """Slugs that occur in any of the result tables."""
    result = None
    for df in tables:
        slugs = df.select(blank_to_null("entity_slug").alias("entity_slug")).where("entity_slug IS NOT NULL")
        result = slugs if result is None else result.union(slugs)
    return result.distinct()


def pending(index: DataFrame, done: DataFrame) -> DataFrame:
    """Index rows whose entity has no result yet."""
    return index.join(done, "entity_slug", "left_anti")


def first_entities(index: DataFrame, limit: int | None, order: Sequence[str]) -> DataFrame:
    """The first rows of an index, for trial runs; all of it without a limit."""
    return index if limit is None else index.orderBy(*order).limit(limit)


def parsed_figures() -> dict[str, Column]:
    """Figures of read pages."""
    good = F.col("error_type").isNull()
    return {"attempted_count": count_rows(), "successful_count": F.count_if(good), "failed_count": F.count_if(~good),
            "new_tag_row_count": F.coalesce(F.sum(F.when(good, F.size("tags"))), F.lit(0))}


def ingest_summary(index: DataFrame, done: DataFrame, parsed: DataFrame, seen: dict[str, int] | None = None) -> DataFrame:
    """One row of figures on a tag ingest run over the pages of the pending entities. `seen` has those of the pages if they were taken while the pages were stored."""
    parts = [
        (index, {"total_records_in_index": count_rows()}),
        (index.join(done, "entity_slug", "left_semi"), {"skipped_count": count_rows()}),
    ]
    if seen is None:
        return report([*parts, (parsed, parsed_figures())])
    return report(parts).select("*", *[F.lit(seen[n]).cast("bigint").alias(n) for n in parsed_figures()])


def require_tag_rows(summary: DataFrame, earlier_rows: int = 0) -> None:
    """Refuse to go on when a non-empty index has brought no tag row at all."""
    got = summary.first()
    if got["total_records_in_index"] and not got["new_tag_row_count"] + earlier_rows:
        raise RuntimeError("a non-empty index brought no tag rows; see the failure table")
