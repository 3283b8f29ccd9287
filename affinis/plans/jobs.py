"""The runs of the batch, each from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affinis.config import AffinityConfig, PAIR_KEY
from affinis.operators import affinity as af, aliases as al, cleaning as cl, discovery as dc, enrich as en, explore as ex
from affinis.operators import groups as gr, paging as pg, snapshots as sn, tiers as ti, trends as tr
from affinis.session import materialise, scratch, stored
from affinis.sinks import batches as bt, records as rc, shards as sh
from affinis.sources import documents as dm, snapshots as ss

# Columns of an entity in the published entity index.
ENTITY_INDEX_COLUMNS = (
    "entity_name", "entity_slug", "color_identity", "total_n", "card_image_url", "partner_card_image_urls", "card_uri", "partner_card_uris",
    "card_names", "origin_set_code", "origin_set_name", "origin_released_at", "set_page_uri", "set_uri", "origin_sets",
)


# Columns of a tag row as it is ingested.
INGEST_SCHEMA = "entity_name string, entity_slug string, total_n bigint, tag_name string, tag_slug string, tag_n bigint, source_type string, observed_at string"


def _save(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        rc.write_records(df, f"{root}/{name}", layout="parquet")


def run_cleaning(index: DataFrame, inputs: Sequence[tuple[str, DataFrame, Sequence[str]]], root: str, status: DataFrame | None = None) -> DataFrame:
    """Clean the inputs, given as (name, rows, ordinal columns), and write eight tables. Gives the report, whose figures were taken while the tables were written."""
    spark = index.sparkSession
    with scratch(spark):
        result, seen = cl.cleaned_once(cl.check_rows(cl.union_inputs(inputs), index), ["input_rank", "input_row"])
        _save({
            "tags_clean": cl.in_clean_order(result.clean), "invalid_rows": result.invalid, "exact_duplicates": result.exact_duplicates,
            "conflicts": cl.in_key_order(result.conflicts), "validation_counts": cl.validation_counts(result.checked, status),
        }, root)
        seen |= rc.write_records(cl.entities(result.clean), f"{root}/entities", layout="parquet", figures={"unique_entity_count_in_clean_rows": F.count(F.lit(1))})
        seen |= rc.write_records(cl.tags(result.clean), f"{root}/tags", layout="parquet", figures={"unique_tag_count_in_clean_rows": F.count(F.lit(1))})
        _save({"validation_report": cl.validation_report(result, index, status, seen)}, root)
    return spark.read.parquet(f"{root}/validation_report")


def run_ingest(index: DataFrame, pages: DataFrame, root: str, batch: str, observed_at: Column, url: Column, earlier_rows: int = 0) -> DataFrame:
    """Read the landed pages (entity_slug, body) of the entities that have no result yet and add their rows and failures as a batch. Gives the summary.

    The run may be repeated under its name: what it has committed is not added again. A non-empty index that has brought no row, in this run,
    in earlier batches or in `earlier_rows`, is an error after all has been written.
    """
    spark = index.sparkSession
    rows_path, failures_path = f"{root}/tag_rows", f"{root}/scrape_failures"
    done = dc.done_slugs(bt.read_batches(spark, rows_path, INGEST_SCHEMA))
    before = bt.committed_rows(spark, rows_path)
    with scratch(spark):
        parsed, seen = stored(dm.read_payloads(pages.join(dc.pending(index, done).select("entity_slug").distinct(), "entity_slug", "left_semi")), dc.parsed_figures())
        summary = dc.ingest_summary(index, done, parsed, seen)
        report = spark.createDataFrame(summary.collect(), summary.schema)  # one row, as it was before the rows are added
        bt.append_batch(dm.payload_rows(parsed, observed_at).drop("tag_no"), rows_path, batch)
        bt.append_batch(dm.payload_failures(parsed, url, observed_at), failures_path, batch)
    dc.require_tag_rows(report, before + earlier_rows)
    return report


def run_analysis(clean: DataFrame, root: str, config: AffinityConfig = AffinityConfig()) -> DataFrame:
    """Score clean rows and write affinity rows, rankings, leaderboard, tag summary and run summary."""
    _save({"affinity_rows": af.analyse(clean, config)}, root)
    affinity = clean.sparkSession.read.parquet(f"{root}/affinity_rows")
    _save({
        "tag_rankings": af.tag_rankings(affinity), "global_leaderboard": af.global_leaderboard(affinity),
        "tag_summary": af.tag_summary(affinity), "analysis_summary": af.analysis_summary(affinity, config),
    }, root)
    return affinity


def run_trends(spark: SparkSession, snapshots: str, current: str, root: str, by_pair: str | None = None) -> DataFrame:
    """Compare a snapshot with the latest older one that has rows, if there is any, and write three tables.

    Which one that is comes from the names of the snapshots; only it is opened. With `by_pair`, both snapshots are kept there in buckets by pair key,
    written when they are first used; comparing them, and every later comparison with one of them, shuffles neither.
    """
    older = sorted((n for n in ss.snapshot_names(spark, snapshots) if sn.is_before(n, current)), reverse=True)
    found = next((n for n in older if not ss.read_snapshot(spark, snapshots, n, check=False).isEmpty()), None)

    def rows_of(name: str) -> DataFrame:
        rows = ss.read_snapshot(spark, snapshots, name)
        if by_pair is None:
            return rows
        if name == current or name not in ss.by_pair_names(spark, by_pair):  # the current one may have been written anew
            ss.store_by_pair(rows, by_pair, name)
        return ss.open_by_pair(spark, by_pair, name)

    now = rows_of(current)
    before = rows_of(found) if found else None
    _save({"trend_rows": tr.trends(now, before, current, found, check=False),
           "affinity_rows_with_trends": tr.attach_previous(now, before, current, found, check=False)}, root)
    rows = spark.read.parquet(f"{root}/trend_rows")
    _save({"trend_summary": tr.trend_summary(rows, now, before)}, root)
    return rows


def replace_empty_snapshot(spark: SparkSession, snapshots: str, current: str, tables: Sequence[str] = (), reports: DataFrame | None = None,
                           report_path: str | None = None) -> DataFrame:
    """Fill an empty snapshot with the latest older one that has rows, in all its tables. Gives the report, and stores it at `report_path`.

    `tables` are folders under `snapshots`, the first of which tells whether a snapshot is empty; without any, `snapshots` is the table.
    `reports` (snapshot_date, clean_tag_row_count as text) go before counted rows. With reports, a snapshot that neither a report nor a
    table knows is an error; having none to fall back on always is. Rows are stored before they are written to the same table. Snapshots are looked
    at from the newest on, until one has rows.
    """
    paths = [f"{snapshots}/{t}" for t in tables] or [snapshots]
    stored = ss.snapshot_names(spark, paths[0])
    told = {} if reports is None else {r[0]: r[1] for r in reports.select("snapshot_date", sn.reported_size(F.col("clean_tag_row_count"), F.lit(None).cast("bigint"))).collect()}
    if reports is not None and current not in stored and told.get(current) is None:
        raise FileNotFoundError(f"there is no snapshot {current}")

    def size(name: str) -> int:
        return told[name] if told.get(name) is not None else ss.snapshot_size(spark, paths[0], name) if name in stored else 0

    sizes = [(current, size(current))]
    for name in sorted((n for n in {*stored, *told} if sn.is_before(n, current)), reverse=True) if sizes[0][1] == 0 else ():
        sizes.append((name, size(name)))
        if sizes[-1][1]:
            break
    made = sn.fallback_report(spark.createDataFrame(sizes, "snapshot_date string, row_count bigint"), current)
    got = made.first()
    report = spark.createDataFrame([got], made.schema)  # one row, as it was before the change
    if got["current_row_count"] == 0:
        if not got["fallback_used"]:
            raise RuntimeError(f"snapshot {current} is empty and no older snapshot holds rows")
        with scratch(spark):
            for path in paths:
                before = spark.read.parquet(path).where(F.col("snapshot_date").cast("string") == got["fallback_snapshot"]).drop("snapshot_date")
                ss.write_snapshot(materialise(before), path, current)
    if report_path:
        rc.write_records(report, report_path, layout="parquet")
    return report


def run_enrichment(spark: SparkSession, entities: DataFrame, cards: DataFrame, prints: DataFrame | None, order: Sequence[str], root: str,
                   tables: Sequence[str] = ()) -> DataFrame:
    """Match entities with cards, write their metadata, and put it into the named tables of `root`."""
    _save({"entity_card_metadata": en.card_metadata(en.match_names(entities, cards, order), cards, prints)}, root)
    metadata = spark.read.parquet(f"{root}/entity_card_metadata")
    _save({"enrichment_failures": metadata.where(~F.col("match_found")), "enrichment_summary": en.enrichment_summary(metadata)}, root)
    with scratch(spark):
        rc.enrich_tables(spark, root, tables, metadata)
    return metadata


def run_publish(rows: DataFrame, summary: DataFrame | None, root: str, config: AffinityConfig = AffinityConfig(), *, summaries: str | None = None,
                layout: str = "json") -> DataFrame:
    """Write every shard family with its index, the leaderboard pages, the run summaries found
    under `summaries`, and the manifest, which names the layout. Gives the manifest.

    The `file` of an index entry is the folder of its shard; in the clustered layout that of the family's table. At the end the stored
    files are read again; a shard that does not hold its rows is an error.
    """
    spark, order = rows.sparkSession, list(PAIR_KEY)
    options = {"layout": layout}
    if summaries:
        rc.copy_tables(spark, summaries, f"{root}/summaries", rc.SUMMARY_TABLES, ())
    with scratch(spark):
        ready = materialise(gr.with_origin_sets(al.fill_columns(rows)))
        set_rows = materialise(gr.set_rows(ready, order))
        theme_rows = materialise(ti.theme_rows(ready, config))
        sh.write_shards(sh.sharded(ready, "entity_slug"), f"{root}/entities", sh.entity_order(ready), **options)
        sh.write_shards(sh.sharded(ready, "tag_slug"), f"{root}/tags", sh.tag_order(ready), **options)
        sh.write_shards(sh.sharded(set_rows.drop("set_place"), "origin_set_code"), f"{root}/sets",
                        [F.col("z").desc_nulls_last(), F.col("entity_name"), F.col("tag_name"), *[F.col(c) for c in order]], **options)
        sh.write_shards(sh.sharded(theme_rows, "theme_tag_slug"), f"{root}/theme-brackets",
                        [F.col("theme_z").desc_nulls_last(), F.col("entity_slug")], **options)
        def filed(index: DataFrame, family: str) -> DataFrame:
            return index.withColumn("file", F.lit(family)) if layout == "clustered" else index

        _save({
            "entities_index": ex.entity_index(ready, order, ENTITY_INDEX_COLUMNS), "tags_index": ex.tag_index(ready, summary, order),
            "sets_index": filed(gr.set_index(set_rows), "sets"), "theme_brackets_index": filed(ti.theme_index(ready, order, summary, config), "theme-brackets"),
        }, root)

        paged = materialise(pg.with_page(pg.with_position(ready, sh.leaderboard_order(ready)), config.page_size))
        sh.write_shards(paged, f"{root}/leaderboard", [F.col("position")], shard="page", **options)
        families = [(ready, "entity_slug", "entities"), (ready, "tag_slug", "tags"), (set_rows, "origin_set_code", "sets"), (theme_rows, "theme_tag_slug", "theme-brackets")]
        sizes = reduce(DataFrame.unionAll, [sh.shard_sizes(df, key, family) for df, key, family in families])
        _save({"leaderboard_index": filed(pg.page_index(paged, config.page_size), "leaderboard"), "shard_sizes": sizes}, root)
        pages = spark.read.parquet(f"{root}/leaderboard_index")
        wanted = spark.read.parquet(f"{root}/shard_sizes")
        page_sizes = pages.select(F.lit("leaderboard").alias("family"), F.col("page").cast("string").alias("shard"), "row_count")
        stored = reduce(DataFrame.unionAll, [
            sh.stored_sizes(spark, f"{root}/{family}", family, layout=layout) if rows_of.take(1) else wanted.limit(0) for rows_of, _, family in families
        ] + [sh.stored_sizes(spark, f"{root}/leaderboard", "leaderboard", shard="page", layout=layout) if paged.take(1) else wanted.limit(0)])
        if layout == "clustered":
            _save({"shard_files": reduce(DataFrame.unionAll, [
                sh.file_index(spark, f"{root}/{family}", shard=shard).select(F.lit(family).alias("family"), "shard", "file", "row_count")
                for family, shard in [*((f, "shard") for _, _, f in families), ("leaderboard", "page")] if rc.exists(spark, f"{root}/{family}/_SUCCESS")])}, root)
        _save({"shard_faults": sh.differing_shards(wanted.unionByName(page_sizes), stored)}, root)
        faults = spark.read.parquet(f"{root}/shard_faults")
        if not faults.isEmpty():
            raise RuntimeError(f"stored shards do not hold their rows: {faults.take(3)}")
        last = pages.agg(F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("rows")).first()
        made = sh.manifest(ready, sh.shard_statistics(wanted))
        _save({"site_manifest": made.select("*", F.lit(layout).alias("layout"), F.lit(config.page_size).cast("bigint").alias("page_size"),
                                            F.lit(last["n"]).cast("bigint").alias("page_count"), F.lit(last["rows"] or 0).cast("bigint").alias("leaderboard_rows"))}, root)
    return spark.read.parquet(f"{root}/site_manifest")
