"""Sinks and sources: rows written in every layout and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from affinis.operators import affinity as af
from affinis.session import materialise, new_path
from affinis.sinks import records as rc, shards as sh
from affinis.sinks.versions import read_table
from affinis.plans.jobs import replace_empty_snapshot
from affinis.sources import records as rd, snapshots as ss
from affinis.sources.cards import read_cards
from catalog.fixtures import PAIRS_SQL, YEARS_SQL, pairs, years
from catalog.registry import query, table

SCHEMA = "entity_name string, entity_slug string, tag_name string, tag_slug string, total_n bigint, tag_n bigint, z double"
ROW = ("entity_slug", "tag_slug")


def folder_of(spark) -> str:
    return new_path(spark, "sink")


def figures(df: DataFrame, layout: str) -> DataFrame:
    """What must survive a round trip: rows, sums, distinct keys, and which values are missing."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("tag_n").alias("sum_tag_n"), F.sum("total_n").alias("sum_total_n"),
        F.count("z").alias("z_count"), F.countDistinct(F.struct(*ROW)).alias("key_count"),
    ).select(F.lit(layout).alias("layout"), "*")


LAYOUTS = ("lines", "lines appended", "array", "array of lines", "parquet", "entity shards", "tag shards", "clustered", "sibling", "copied", "enriched")


@query("sink_round_trip", "WITH " + PAIRS_SQL + f"""
SELECT layout, (SELECT count(*) FROM pairs) * n AS row_count, (SELECT sum(tag_n) FROM pairs)::BIGINT * n AS sum_tag_n, (SELECT sum(total_n) FROM pairs)::BIGINT * n AS sum_total_n,
  (SELECT count(*) FROM pairs WHERE tag_n > 20) * n AS z_count, (SELECT count(DISTINCT (entity_slug, tag_slug)) FROM pairs) AS key_count
FROM (VALUES {', '.join(f"('{x}', {2 if x == 'lines appended' else 1})" for x in LAYOUTS)}) l(layout, n)""")
def sink_round_trip(spark, folder):
    """Rows with NaN in place of some numbers, through every layout and back."""
    out = folder_of(spark)
    z = F.when(F.col("tag_n") > 20, F.col("tag_n") / F.col("total_n")).otherwise(F.lit(float("nan")))
    rows = materialise(pairs(spark, folder).withColumn("z", z).select(*[c.split()[0] for c in SCHEMA.split(", ")]))
    rc.write_records(rows, f"{out}/lines.jsonl")
    rc.write_records(rows, f"{out}/twice.jsonl")
    rc.append_records(rows, f"{out}/twice.jsonl")
    rc.write_records(rows, f"{out}/array.json", layout="array")
    rc.lines_to_arrays(spark, f"{out}/lines.jsonl", f"{out}/arrays.json", SCHEMA)
    rc.write_records(rows, f"{out}/set/parquet", layout="parquet")
    sh.write_shards(sh.sharded(rows, "entity_slug"), f"{out}/entities", sh.entity_order(rows))
    sh.write_shards(sh.sharded(rows, "tag_slug"), f"{out}/tags", sh.tag_order(rows))
    sh.write_shards(sh.sharded(rows, "entity_slug"), f"{out}/clustered", sh.entity_order(rows), layout="clustered")
    for target in ("copy", "plain"):
        rc.copy_tables(spark, f"{out}/set", f"{out}/{target}", ["parquet"], ["absent"])
    metadata = rows.select("entity_slug").distinct().withColumn("card_image_url", F.concat(F.lit("img-"), F.col("entity_slug")))
    rc.enrich_tables(spark, f"{out}/copy", ["parquet", "absent"], metadata)
    back = {
        "lines": rd.read_records(spark, f"{out}/lines.jsonl", SCHEMA),
        "lines appended": rd.read_records(spark, f"{out}/twice.jsonl", SCHEMA),
        "array": rd.read_records(spark, f"{out}/array.json", SCHEMA, layout="array"),
        "array of lines": rd.read_array(spark, f"{out}/arrays.json", SCHEMA),
        "parquet": rd.read_facts(spark, f"{out}/set/parquet", SCHEMA),
        "entity shards": spark.read.schema(SCHEMA + ", shard string").json(f"{out}/entities"),
        "tag shards": spark.read.schema(SCHEMA + ", shard string").json(f"{out}/tags"),
        "clustered": spark.read.parquet(f"{out}/clustered"),
        "sibling": rd.read_records(spark, f"{out}/array.jsonl", SCHEMA),
        "copied": spark.read.parquet(f"{out}/plain/parquet"),
        "enriched": read_table(spark, f"{out}/copy/parquet").where("card_image_url IS NOT NULL"),
    }
    result = None
    for layout in LAYOUTS:
        one = figures(back[layout], layout)
        result = one if result is None else result.unionAll(one)
    return result


@query("snapshot_scan", "WITH " + YEARS_SQL + """
SELECT entity_slug, tag_slug, total_n, tag_n FROM dated WHERE snapshot_date = '1997-01-01'""")
def snapshot_scan(spark, folder):
    """All snapshots written as date partitions; the scan reads the one that is asked for."""
    root = folder_of(spark)
    rows = years(spark, folder)
    rows.withColumn("snapshot_date", F.col("snapshot_date").cast("date")).write.partitionBy("snapshot_date").parquet(root)
    return ss.read_snapshot(spark, root, "1997-01-01").select(*ROW, "total_n", "tag_n")


@query("publish_manifest", "WITH " + PAIRS_SQL + """
SELECT 'site_manifest' AS table_name, true AS copied, (SELECT count(*) FROM pairs) AS total_rows UNION ALL SELECT 'tag_summary', true, (SELECT count(DISTINCT tag_slug) FROM pairs)
UNION ALL SELECT 'trend_rows', false, 0""")
def publish_manifest(spark, folder):
    """Two tables of the publish set copied, an optional third one missing."""
    out = folder_of(spark)
    rows = materialise(af.add_share(pairs(spark, folder)))
    rc.write_records(rows, f"{out}/in/site_manifest", layout="parquet")
    rc.write_records(rows.groupBy("tag_slug").count(), f"{out}/in/tag_summary", layout="parquet")
    manifest = rc.copy_tables(spark, f"{out}/in", f"{out}/out", ["site_manifest", "tag_summary"], ["trend_rows"])
    sizes = None
    for name in ("site_manifest", "tag_summary"):
        one = spark.read.parquet(f"{out}/out/{name}").agg(F.count(F.lit(1)).alias("total_rows")).withColumn("table_name", F.lit(name))
        sizes = one if sizes is None else sizes.unionByName(one)
    return manifest.join(sizes, "table_name", "left").select("table_name", "copied", F.coalesce("total_rows", F.lit(0)).alias("total_rows"))


# The last entity's shard is never written.
@query("stored_shard_check", "WITH " + PAIRS_SQL + """
SELECT 'entities' AS family, entity_slug AS shard, count(*) AS wanted_rows, NULL::BIGINT AS stored_rows FROM pairs
WHERE entity_slug = (SELECT max(entity_slug) FROM pairs) GROUP BY entity_slug""")
def stored_shard_check(spark, folder):
    """Shards written without the last entity, then held against what should be there."""
    out = folder_of(spark)
    rows = materialise(pairs(spark, folder))
    lost = rows.agg(F.max("entity_slug")).first()[0]
    sh.write_shards(sh.sharded(rows.where(F.col("entity_slug") != lost), "entity_slug"), f"{out}/entities", sh.entity_order(rows))
    return sh.differing_shards(sh.shard_sizes(rows, "entity_slug", "entities"), sh.stored_sizes(spark, f"{out}/entities", "entities"))


@query("shard_files", "WITH " + PAIRS_SQL + """
SELECT 'tags/shard=' || tag_slug AS file, entity_slug, tag_n, row_number() OVER (PARTITION BY tag_slug ORDER BY tag_n DESC, entity_slug) - 1 AS place FROM pairs""")
def shard_files(spark, folder):
    """The files of all tags, read in one scan and held against the names an index gives them, with each row's place in its shard."""
    out = folder_of(spark)
    rows = materialise(pairs(spark, folder))
    order = [F.col("tag_n").desc(), F.col("entity_slug")]
    sh.write_shards(sh.sharded(rows, "tag_slug"), f"{out}/tags", order)
    index = rows.select(F.concat(F.lit("tags/shard="), "tag_slug").alias("file")).distinct()
    read = rd.with_file_order(sh.read_shards(spark, f"{out}/tags", "entity_slug string, tag_n bigint")).withColumn("file", F.concat(F.lit("tags/shard="), "shard"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("ordinal")).cast("bigint") - 1
    return read.withColumn("place", place).join(index, "file").select("file", "entity_slug", "tag_n", "place")


# The tag of the most rows, and the least of them by name.
@query("clustered_shard", "WITH " + PAIRS_SQL + """
SELECT entity_slug, tag_slug, tag_n, row_number() OVER (ORDER BY tag_n DESC, entity_slug) - 1 AS place, true AS others_unread FROM pairs
WHERE tag_slug = (SELECT tag_slug FROM pairs GROUP BY tag_slug ORDER BY count(*) DESC, tag_slug LIMIT 1)""")
def clustered_shard(spark, folder):
    """One shard looked up in the clustered layout by its file index, with each row's place, and whether no file but those of the index was opened."""
    out = folder_of(spark)
    rows = materialise(pairs(spark, folder))
    order = [F.col("tag_n").desc(), F.col("entity_slug")]
    sh.write_shards(sh.sharded(rows, "tag_slug"), f"{out}/tags", order, layout="clustered")
    index = materialise(sh.file_index(spark, f"{out}/tags"))
    shard = index.groupBy("shard").agg(F.sum("row_count").alias("n")).orderBy(F.col("n").desc(), "shard").first()["shard"]
    found = sh.read_clustered_shard(spark, f"{out}/tags", index, shard)
    opened = {name.rsplit("/", 1)[1] for name in found.inputFiles()}
    only = opened == {r["file"] for r in index.where(F.col("shard") == shard).collect()}
    place = F.row_number().over(Window.partitionBy("shard").orderBy(*order)).cast("bigint") - 1  # one shard, the one asked for
    return found.select("entity_slug", "tag_slug", "tag_n", place.alias("place"), F.lit(only).alias("others_unread"))


@query("copy_modes", "WITH " + PAIRS_SQL + """
SELECT mode, (SELECT count(*) FROM pairs) AS row_count, mode = 'keep' AS other_kept FROM (VALUES ('keep'), ('clean')) m(mode)""")
def copy_modes(spark, folder):
    """A table copied twice in each mode, beside one that does not belong to the set."""
    out = folder_of(spark)
    rc.write_records(pairs(spark, folder), f"{out}/in/facts", layout="parquet")
    rows = []
    for mode in ("keep", "clean"):
        rc.write_records(spark.range(1), f"{out}/{mode}/other", layout="parquet")
        for _ in range(2):
            rc.copy_tables(spark, f"{out}/in", f"{out}/{mode}", ["facts"], [], clean=mode == "clean")
        counted = spark.read.parquet(f"{out}/{mode}/facts").agg(F.count(F.lit(1)).alias("row_count"))
        rows.append(counted.select(F.lit(mode).alias("mode"), "row_count", F.lit(rd.exists(spark, f"{out}/{mode}/other")).alias("other_kept")))
    return rows[0].unionAll(rows[1])


@query("wrapped_scan", "WITH " + PAIRS_SQL + "SELECT entity_slug, tag_slug, total_n, tag_n FROM pairs")
def wrapped_scan(spark, folder):
    """An object for each entity that holds its records under a key, read as wrapped files."""
    out = folder_of(spark)
    record = F.struct("entity_slug", "tag_slug", "total_n", "tag_n")
    wrapped = materialise(pairs(spark, folder).groupBy("entity_slug").agg(F.collect_list(record).alias("rows")))
    # one file for each object: a wrapped file is read whole
    lines = wrapped.select(F.col("entity_slug").alias("shard"), F.to_json(F.struct("rows")).alias("value"))
    lines.repartition(*sh.folder_tasks(lines), "shard").write.partitionBy("shard").text(out)
    return rd.read_records(spark, out, "entity_slug string, tag_slug string, total_n bigint, tag_n bigint", layout="wrapped")


@query("index_scan", "SELECT 's' || s_suppkey AS entity_slug, s_name AS entity_name FROM supplier")
def index_scan(spark, folder):
    """An entity index written as a JSON array and read with its check."""
    out = folder_of(spark)
    index = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug"), F.col("s_name").alias("entity_name"))
    rc.write_records(index, out, layout="array")
    return rd.read_index(spark, out, "entity_slug string, entity_name string")


@query("status_scan", "SELECT o_orderstatus AS status_type, count(*) AS row_count FROM orders GROUP BY ALL")
def status_scan(spark, folder):
    """Status lines read back, beside a missing file, which is an empty table."""
    out = folder_of(spark)
    schema = "order_key bigint, status_type string"
    rc.write_records(table(spark, folder, "orders").select(F.col("o_orderkey").cast("bigint").alias("order_key"), F.col("o_orderstatus").alias("status_type")), f"{out}/status")
    both = rd.read_status(spark, f"{out}/status", schema).unionAll(rd.read_status(spark, f"{out}/none", schema))
    return both.groupBy("status_type").agg(F.count(F.lit(1)).alias("row_count"))


@query("card_scan", "SELECT p_name AS card_name, 'id-' || p_partkey AS card_id, 'https://cards.example/' || p_partkey AS card_uri, lower(p_brand) AS set_code FROM part")
def card_scan(spark, folder):
    """Bulk card lines under the provider's names, read as cards."""
    out = folder_of(spark)
    key = F.col("p_partkey").cast("string")
    rc.write_records(table(spark, folder, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("id-"), key).alias("id"), F.lower("p_brand").alias("set"),
                                                         F.concat(F.lit("https://cards.example/"), key).alias("page")), out)
    return read_cards(spark, out, "page", "set_page").select("card_name", "card_id", "card_uri", "set_code")


@query("snapshot_replaced", "WITH " + YEARS_SQL + """
, latest AS (SELECT max(snapshot_date) AS d FROM dated)
SELECT t.name AS table_name, (SELECT count(*) FROM dated WHERE snapshot_date = (SELECT d FROM latest)) AS row_count,
  (SELECT sum(tag_n) FROM dated WHERE snapshot_date = (SELECT d FROM latest))::BIGINT AS sum_tag_n, (SELECT d FROM latest) AS fallback_snapshot
FROM (VALUES ('facts'), ('copies')) t(name)""")
def snapshot_replaced(spark, folder):
    """Both tables of an undated, empty snapshot filled from the latest dated one, and the stored report."""
    root = folder_of(spark)
    rows = materialise(years(spark, folder))
    for name in ("facts", "copies"):
        rows.write.partitionBy("snapshot_date").parquet(f"{root}/{name}")
    reports = spark.createDataFrame([("newest", "0")], "snapshot_date string, clean_tag_row_count string")
    replace_empty_snapshot(spark, root, "newest", ["facts", "copies"], reports, f"{root}/report")
    told = spark.read.parquet(f"{root}/report").select("fallback_snapshot")
    parts = [ss.read_snapshot(spark, f"{root}/{name}", "newest").agg(F.count(F.lit(1)).alias("row_count"), F.sum("tag_n").alias("sum_tag_n")).select(F.lit(name).alias("table_name"), "*") for name in ("facts", "copies")]
    stored = parts[0].unionAll(parts[1])
    return stored.withColumn("fallback_snapshot", F.lit(told.first()["fallback_snapshot"]))
