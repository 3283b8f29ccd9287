"""Published files: every shard and page of a publish run read back through its index, summaries, and the guard of the scrape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from affinis.functions.text import safe_slug
from affinis.operators import discovery as dc
from affinis.plans.jobs import run_publish
from affinis.session import materialise, new_path
from affinis.sinks import records as rc, shards as sh
from affinis.sources import documents as dm, records as rd
from catalog.affinity_queries import analysis_summary, tag_summary
from catalog.explore_queries import PAGED
from catalog.fixtures import STRICT
from catalog.ingest_queries import PAYLOAD_SQL, payloads
from catalog.registry import SQL, joined, query, table
from catalog.set_queries import IN_SIGNALS, WITH, enriched
from catalog.trend_queries import trend_summary

PLAIN = "entity_slug string, tag_slug string, tag_n bigint"
THEME = "entity_slug string, theme_tag_slug string, theme_tag_n bigint, bracket_tag_rows array<struct<tag_slug:string,tag_n:bigint>>"


def published(spark, folder, **options) -> str:
    """Folder of a whole publish run."""
    out = new_path(spark, "site")
    run_publish(enriched(spark, folder), None, out, STRICT, **options)
    return out


def stored_rows(spark, out: str, family: str, schema: str, index: DataFrame, shard: str = "shard") -> DataFrame:
    """All rows of a family whose file is in its index, with the place of each in its file."""
    rows = sh.of_shards(spark, f"{out}/{family}", schema, rd.with_file_order, shard=shard).withColumn(
        "file", F.concat(F.lit(f"{family}/{shard}="), F.col(shard).cast("string")))
    place = F.row_number().over(Window.partitionBy("file").orderBy("ordinal")).cast("bigint") - 1
    # The rows are dealt by file for their place; an index of very many files is dealt likewise, and not broadcast by way of the driver.
    return rows.withColumn("place", place).join(index.select("file").hint("merge"), "file")


# The order of the rows in a shard, as its place.
def _place(by: str, order: str) -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS place"


@query("shard_family_rows", WITH + f"""
, sig AS (SELECT entity_slug, string_agg(tag_slug || ':' || tag_n, '|' ORDER BY tag_slug) AS signals FROM affinity WHERE {IN_SIGNALS} GROUP BY entity_slug)
SELECT 'entities/shard=' || entity_slug AS file, entity_slug, tag_slug, tag_n, NULL AS signals, {_place('entity_slug', 'z DESC NULLS LAST, tag_slug')} FROM affinity
UNION ALL SELECT 'tags/shard=' || tag_slug, entity_slug, tag_slug, tag_n, NULL, {_place('tag_slug', 'rank_within_tag_by_z NULLS LAST, entity_slug')} FROM affinity
UNION ALL SELECT 'sets/shard=' || code, entity_slug, tag_slug, tag_n, NULL, {_place('code', 'z DESC NULLS LAST, entity_name, tag_name, entity_slug, tag_slug')}
  FROM affinity JOIN sets USING (entity_slug)
UNION ALL SELECT 'theme-brackets/shard=' || tag_slug, entity_slug, tag_slug, tag_n, coalesce(signals, ''), {_place('tag_slug', 'z DESC NULLS LAST, entity_slug')}
  FROM affinity LEFT JOIN sig USING (entity_slug) WHERE {IN_SIGNALS} OR z >= 1.05""")
def shard_family_rows(spark, folder):
    """Every row of every shard of the four families, by the files that the published indexes name, with its place in its shard."""
    out = published(spark, folder)

    def index(name: str, file: Column | None = None) -> DataFrame:
        entries = spark.read.parquet(f"{out}/{name}")
        return entries if file is None else entries.withColumn("file", file)

    none = F.lit(None).cast("string")
    families = [
        ("entities", PLAIN, index("entities_index", F.concat(F.lit("entities/shard="), safe_slug("entity_slug")))),
        ("tags", PLAIN, index("tags_index", F.concat(F.lit("tags/shard="), safe_slug("tag_slug")))),
        ("sets", PLAIN, index("sets_index")),
    ]
    tags = F.transform("bracket_tag_rows", lambda r: F.concat(r["tag_slug"], F.lit(":"), r["tag_n"].cast("string")))
    result = stored_rows(spark, out, "theme-brackets", THEME, index("theme_brackets_index")).select(
        "file", "entity_slug", F.col("theme_tag_slug").alias("tag_slug"), F.col("theme_tag_n").alias("tag_n"), joined(tags).alias("signals"), "place")
    for family, schema, entries in families:
        rows = stored_rows(spark, out, family, schema, entries)
        result = result.unionAll(rows.select("file", "entity_slug", "tag_slug", "tag_n", none.alias("signals"), "place"))
    return result


@query("page_files", PAGED + """
SELECT 'leaderboard/page=' || page AS file, entity_slug, tag_slug, position, position % 500 AS place, (page - 1) * 500 AS start_row,
  (page - 1) * 500 + count(*) OVER (PARTITION BY page) AS end_row, count(*) OVER (PARTITION BY page) AS row_count FROM paged""")
def page_files(spark, folder):
    """Every row of every page file that the published index names, with its place in the page and the page's entry."""
    out = published(spark, folder)
    index = spark.read.parquet(f"{out}/leaderboard_index")
    rows = stored_rows(spark, out, "leaderboard", "entity_slug string, tag_slug string, position bigint", index, "page")
    return rows.drop("page").join(index, "file").select("file", "entity_slug", "tag_slug", "position", "place", "start_row", "end_row", "row_count")


SUMMARY_COLUMNS = {
    "analysis_summary": ("affinity_row_count", "global_leaderboard_row_count", "analysis_eligible_row_count", "rows_with_missing_z", "unique_entity_count",
                         "tag_summary_row_count", "unique_tag_count", "min_total_n_default", "min_tag_n_default"),
    "trend_summary": ("trend_row_count", "existing_pair_count", "new_pair_count", "removed_pair_count", "no_previous_snapshot_count", "rows_with_total_n_delta",
                      "rows_with_tag_n_delta", "rows_with_affinity_pct_delta", "rows_with_z_delta", "rows_with_rank_delta", "current_row_count", "previous_row_count"),
    "tag_summary": ("tag_slug", "tag_name", "tag_row_count", "eligible_row_count", "max_tag_n", "max_total_n"),
}


@query("summaries_copied", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, concat_ws('|', {', '.join(columns)}) AS figures FROM ({SQL[name]}) {name}_rows" for name, columns in SUMMARY_COLUMNS.items()))
def summaries_copied(spark, folder):
    """The run summaries as they stand in the publish area after a publish run."""
    source = new_path(spark, "summaries")
    for name, made in (("analysis_summary", analysis_summary), ("trend_summary", trend_summary), ("tag_summary", tag_summary)):
        rc.write_records(made(spark, folder), f"{source}/{name}", layout="parquet")
    out = published(spark, folder, summaries=source)
    result = None
    for name, columns in SUMMARY_COLUMNS.items():
        one = spark.read.parquet(f"{out}/summaries/{name}").select(F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("figures"))
        result = one if result is None else result.unionAll(one)
    return result


# Pages of kinds 2 to 5 and 9 are broken; only a run of nothing else, without rows of an earlier one, is refused.
@query("zero_rows_guard", PAYLOAD_SQL + """
, got AS (SELECT count(*) FILTER (WHERE kind IN (0, 1, 6, 7, 8)) AS good, (SELECT count(*) FROM supplier) AS entries FROM kinds)
SELECT c.run, CASE WHEN c.run = 'empty index' THEN 0 ELSE entries END AS total_records_in_index, CASE WHEN c.run = 'all pages' THEN good ELSE 0 END AS new_tag_row_count,
  c.run = 'broken pages' OR (c.run = 'all pages' AND entries > 0 AND good = 0) AS refused
FROM got, (VALUES ('all pages'), ('broken pages'), ('broken pages, earlier rows'), ('empty index')) c(run)""")
def zero_rows_guard(spark, folder):
    """The guard over four runs; a refusal is told as a row."""
    index = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug"))
    pages = materialise(payloads(spark, folder))
    kind = F.substring("entity_slug", 2, 20).cast("bigint") % 10
    broken = pages.where(kind.isin(2, 3, 4, 5, 9))
    runs = [("all pages", index, pages, 0), ("broken pages", index, broken, 0), ("broken pages, earlier rows", index, broken, 1), ("empty index", index.limit(0), pages.limit(0), 0)]
    told = []
    for run, entries, read, earlier in runs:
        summary = materialise(dc.ingest_summary(entries, dc.done_slugs(index.limit(0)), dm.read_payloads(read)))  # one row, looked at twice
        try:
            dc.require_tag_rows(summary, earlier)
            refused = False
        except RuntimeError:
            refused = True
        got = summary.first()
        told.append((run, got["total_records_in_index"], got["new_tag_row_count"], refused))
    return spark.createDataFrame(told, "run string, total_records_in_index bigint, new_tag_row_count bigint, refused boolean")
