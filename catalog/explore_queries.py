"""Browsing: filters, sorts, search, roll-ups, aliases, pages, text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions import text as tx
from affinis.operators.cleaning import in_clean_order
from affinis.operators import affinity as af, aliases as al, explore as ex, groups as gr, paging as pg, trends as tr
from affinis.session import materialise
from affinis.sinks import shards as sh
from catalog.fixtures import DIRTY_SQL, PAIRS_SQL, STRICT, affinity_sql, pairs
from catalog.registry import joined, query, rounded, table
from catalog.set_queries import SETS_SQL, analysed, enriched, entities
from catalog.trend_queries import CURRENT, PREVIOUS, TRENDS, both, by_pair, trend_frame
from catalog.cleaning_queries import cleaned

SCORED = "WITH " + PAIRS_SQL + "," + affinity_sql()
ROW = ("entity_slug", "tag_slug")

SEARCH = """(contains(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '{1}') OR contains(regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g'), '{2}'))"""


def search_sql(columns, spaced, compact):
    return "(" + " OR ".join(SEARCH.format(c, spaced, compact) for c in columns) + ")"


@query("explore_leaderboard", TRENDS + f"""
SELECT c.entity_slug, c.tag_slug, c.total_n, c.tag_n, round(c.z, 6) AS z, t.snapshot_status AS trend_status, t.rank_delta::DOUBLE AS rank_delta
FROM c_affinity c JOIN trend_rows t USING (entity_slug, tag_slug)
WHERE {search_sql(['c.entity_name', 'c.entity_slug', 'c.tag_name', 'c.tag_slug'], 'brand 2', 'brand2')} AND c.total_n >= 4 AND c.tag_n >= 2 AND c.z >= 0.5 AND c.z <= 3
  AND t.snapshot_status = 'existing'""")
def explore_leaderboard(spark, folder):
    current, previous = both(spark, folder)
    current = materialise(current)
    current = by_pair(current, current.count())
    rows = tr.attach_trends(current, tr.trends(current, previous, CURRENT, PREVIOUS, check=False))
    found = ex.filter_rows(ex.with_trend_fields(rows), "BRAND-2", "4", 2, "0.5", 3, "existing")
    return rounded(ex.sort_rows(found, "z", ties=ROW).select(*ROW, "total_n", "tag_n", "z", "trend_status", "rank_delta"))


@query("explore_tag", SCORED + f"""
SELECT entity_slug, tag_slug, total_n, tag_n, rank_within_tag_by_z, round(z, 6) AS z FROM affinity
WHERE tag_slug = 'brand-7' AND {search_sql(['entity_name', 'entity_slug', 'tag_name', 'tag_slug'], 'supplier s1', 'suppliers1')} AND total_n >= 200 AND tag_n >= 5 AND z >= -1""")
def explore_tag(spark, folder):
    one = analysed(spark, folder).where("tag_slug = 'brand-7'")
    found = ex.filter_rows(one, "supplier-s1", min_z=-1, max_z="")
    return rounded(ex.sort_rows(found, "rank_within_tag_by_z", descending=False, ties=ROW).select(*ROW, "total_n", "tag_n", "rank_within_tag_by_z", "z"))


@query("explore_set", SCORED + "," + SETS_SQL + f"""
SELECT a.entity_slug, a.tag_slug, s.code AS origin_set_code, a.total_n, a.tag_n, round(a.z, 6) AS z FROM affinity a JOIN sets s USING (entity_slug)
WHERE {search_sql(['a.entity_name', 'a.entity_slug', 's.set_name', 's.code'], 'nation 1', 'nation1')} AND {search_sql(['tag_name', 'tag_slug'], 'brand 1', 'brand1')}
  AND total_n >= 400 AND tag_n >= 10 AND z >= 0 AND z <= 2.5""")
def explore_set(spark, folder):
    rows = gr.set_rows(enriched(spark, folder), ROW)
    found = ex.filter_rows(rows, "nation_1", 400, 10, 0, "2.5", tag_query="Brand#1", text=ex.SET_ROW_TEXT)
    return rounded(ex.sort_rows(found, "z", ties=ROW).select(*ROW, "origin_set_code", "total_n", "tag_n", "z"))


@query("explore_set_list", "WITH " + SETS_SQL + f"SELECT DISTINCT code AS set_code FROM sets WHERE {search_sql(['set_name', 'code'], 'nation 2', 'nation2')}")
def explore_set_list(spark, folder):
    rows = entities(spark, folder)
    sets = rows.select(F.explode(gr.sets_of_row(rows)).alias("s")).select("s.set_name", "s.set_code")
    return sets.where(ex.text_matches(ex.SET_TEXT, "nation 2")).select("set_code").distinct()


@query("unrouted_filters", SCORED + """
SELECT entity_slug, tag_slug, tag_n, round(tag_affinity_pct * 100, 6) AS shown_pct FROM affinity
WHERE contains(lower(entity_name), 's2') AND contains(lower(tag_name), 'brand#1') AND contains('w,' || lower(right(entity_slug, 1)), '3') AND total_n >= 400 AND tag_n >= 10
  AND z >= -2 AND tag_affinity_pct * 100 >= 3.5""")
def unrouted_filters(spark, folder):
    rows = analysed(spark, folder).drop("tag_affinity_pct_display").withColumn("color_identity", F.array(F.lit("W"), F.substring("entity_slug", -1, 1)))
    found = ex.filter_by_substring(rows, "S2", "brand#1", "3", 400, 10, -2, 3.5)
    return rounded(found.select(*ROW, "tag_n", ex.display_pct(rows).alias("shown_pct")))


@query("sort_by_any_column", SCORED + """
SELECT entity_slug, tag_slug, row_number() OVER (ORDER BY CASE WHEN tag_n > 20 THEN z END DESC NULLS FIRST, entity_slug, tag_slug) - 1 AS position FROM affinity""")
def sort_by_any_column(spark, folder):
    """Descending user sort with missing numbers first, told by the position of each row."""
    rows = analysed(spark, folder).withColumn("z", F.when(F.col("tag_n") > 20, F.col("z")))
    return pg.with_position(rows, ex.sort_keys(rows, "z", True, ROW)).select(*ROW, "position")


@query("entity_search", SCORED + """
SELECT entity_slug, entity_name, max(total_n) AS total_n FROM affinity WHERE contains(lower(entity_name), 'er s1') GROUP BY ALL ORDER BY total_n DESC, entity_slug LIMIT 20 OFFSET 2""")
def entity_search(spark, folder):
    """The third to the twenty-second entity found, as on a page that grows."""
    rows = pairs(spark, folder).groupBy("entity_slug", "entity_name").agg(F.max("total_n").alias("total_n"))
    return ex.window_of(ex.search_entities(rows, " ER s1"), 20, 2)


@query("entity_best_tags", SCORED + """
SELECT entity_slug, tag_slug, row_number() OVER (PARTITION BY entity_slug ORDER BY z DESC NULLS LAST, tag_n DESC, tag_slug)::INT AS tag_rank FROM affinity
QUALIFY row_number() OVER (PARTITION BY entity_slug ORDER BY z DESC NULLS LAST, tag_n DESC, tag_slug) <= 5""")
def entity_best_tags(spark, folder):
    return ex.best_tags(analysed(spark, folder)).select("entity_slug", "tag_slug", "tag_rank")


@query("entity_highlights", SCORED + """
SELECT entity_slug, arg_min(tag_slug, (-z, tag_slug)) AS strongest_tag, round(max(z), 6) AS strongest_z, arg_min(tag_slug, (-tag_n, tag_slug)) AS largest_tag,
  max(tag_n) AS largest_n FROM affinity GROUP BY entity_slug""")
def entity_highlights(spark, folder):
    rows = ex.highlights(analysed(spark, folder))
    return rounded(rows.select("entity_slug", F.col("strongest_tag.tag_slug").alias("strongest_tag"), F.col("strongest_tag.z").alias("strongest_z"),
                               F.col("largest_tag.tag_slug").alias("largest_tag"), F.col("largest_tag.tag_n").alias("largest_n")))


# Rows as older files bring them: other names, one image, two lists as comma texts.
@query("entity_rollup", SCORED + """
, top AS (SELECT *, row_number() OVER (PARTITION BY entity_slug ORDER BY z DESC NULLS LAST, tag_n DESC, tag_slug) AS r FROM affinity)
SELECT entity_slug, any_value(entity_name) AS entity_name, max(total_n) AS total_n, max(rank_within_tag_by_z)::DOUBLE AS best_rank_delta,
  string_agg(CASE WHEN r <= 5 THEN tag_slug END, '|' ORDER BY r) AS top_tags, 'img-' || max(tag_n) FILTER (WHERE tag_slug = 'brand-9') AS card_image_url,
  'a|b' AS card_names, 'W|U' AS color_identity FROM top GROUP BY entity_slug""")
def entity_rollup(spark, folder):
    rows = analysed(spark, folder)
    old = rows.select(
        F.col("entity_name").alias("entity"), "entity_slug", F.col("tag_name").alias("tag"), "tag_slug", F.col("total_n").alias("total_n_x"), "tag_n", "z",
        F.col("rank_within_tag_by_z").alias("rank_within_tag_by_z_delta"),
        F.when(F.col("tag_slug") == "brand-9", F.concat(F.lit("img-"), F.col("tag_n").cast("string"))).otherwise("").alias("image_url"),
        F.when(F.col("tag_slug") == "brand-20", "a, b ,a").otherwise("c").alias("partner_card_names"), F.lit("WU").alias("color"))
    rolled = al.roll_up(al.usual_rows(old), ["tag_slug"])
    tags = F.transform("top_tags", lambda t: t["tag_slug"])
    return rolled.select("entity_slug", "entity_name", "total_n", "best_rank_delta", joined(tags).alias("top_tags"), "card_image_url",
                         joined("card_names").alias("card_names"), joined("color_identity").alias("color_identity"))


@query("alias_rows", TRENDS + """
, v AS (SELECT *, coalesce(total_n_current, 0) AS n FROM trend_rows)
SELECT entity_slug, tag_slug, total_n_current AS total_n, tag_n_current AS tag_n, affinity_pct_current AS tag_affinity_pct,
  round(tag_n_current::DOUBLE / total_n_current * 100, 6) AS shown_pct, z_current AS z, snapshot_status AS trend_status,
  rank_delta::DOUBLE AS rank_delta, CASE WHEN snapshot_status = 'new_pair' THEN 'New pair' WHEN snapshot_status = 'removed_pair' THEN 'Removed pair'
    WHEN rank_delta > 0 THEN '▲ Rank +' || rank_delta WHEN rank_delta < 0 THEN '▼ Rank -' || abs(rank_delta) ELSE 'Existing' END AS trend_label FROM v""")
def alias_rows(spark, folder):
    """Trend rows taken as rows of the browser: filled columns, row aliases, trend wording."""
    rows = al.usual_rows(al.fill_columns(trend_frame(spark, folder)))
    shown = ex.with_trend_fields(rows).withColumn("trend_label", ex.trend_label("trend_status", "rank_delta"))
    return rounded(shown.select(*ROW, "total_n", "tag_n", "tag_affinity_pct", ex.display_pct(shown).alias("shown_pct"), "z", "trend_status", "rank_delta", "trend_label"))


@query("summary_aliases", SCORED + """
SELECT tag_slug, count(*)::DOUBLE AS row_count, count(*) FILTER (WHERE analysis_eligible)::DOUBLE AS eligible_count, round(avg(tag_affinity_pct), 6) AS mean_pct,
  round(stddev_samp(tag_affinity_pct), 6) AS std_pct, round(max(z), 6) AS max_z FROM affinity GROUP BY tag_slug""")
def summary_aliases(spark, folder):
    old = af.tag_summary(analysed(spark, folder)).select(
        "tag_slug", F.col("tag_row_count").alias("total_row_count"), F.col("eligible_row_count").cast("string").alias("analysis_eligible_row_count"),
        F.col("tag_mean_pct").alias("avg_affinity_pct"), F.col("tag_std_pct").alias("std_pct"), F.col("max_z").alias("highest_z"))
    return rounded(ex.summary_card(old))


@query("chart_top_n", SCORED + """
SELECT * FROM (SELECT 'z' AS chart, entity_name AS name, entity_slug, tag_slug, round(z, 2) AS value FROM affinity ORDER BY z DESC, entity_slug, tag_slug LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'n', entity_name, entity_slug, tag_slug, tag_n::DOUBLE FROM affinity ORDER BY tag_n DESC, entity_slug, tag_slug LIMIT 10)""")
def chart_top_n(spark, folder):
    rows = analysed(spark, folder)
    strongest = ex.top_values(rows, "z", 10, 2).withColumn("chart", F.lit("z"))
    largest = ex.top_values(rows, "tag_n", 10).withColumn("chart", F.lit("n")).withColumn("value", F.col("value").cast("double"))
    return strongest.unionByName(largest)


@query("tag_options", SCORED + "SELECT tag_slug AS slug, arg_min(tag_name || CASE WHEN tag_n > 25 THEN '!' ELSE '' END, entity_slug) AS name FROM affinity GROUP BY tag_slug")
def tag_options(spark, folder):
    rows = pairs(spark, folder).withColumn("tag_name", F.concat("tag_name", F.when(F.col("tag_n") > 25, "!").otherwise("")))
    return ex.tag_options(rows, ["entity_slug"])


@query("tag_lookup", SCORED + """
SELECT tag_slug, tag_name, count(*) AS tag_row_count FROM affinity WHERE tag_name = 'Brand#3' OR tag_slug = 'brand-4' GROUP BY ALL""")
def tag_lookup(spark, folder):
    """One tag found by its name, one by its slug."""
    summary = materialise(af.tag_summary(analysed(spark, folder))).select("tag_slug", "tag_name", "tag_row_count")
    return ex.find_tag(summary, "Brand#3").unionAll(ex.find_tag(summary, "brand-4"))


@query("entity_index", SCORED + """
SELECT entity_slug, entity_name, max(total_n) AS total_n, arg_min(tag_n, tag_slug) AS tag_n FROM affinity GROUP BY ALL""")
def entity_index(spark, folder):
    return ex.entity_index(pairs(spark, folder), ["tag_slug"], ["entity_name", "entity_slug", "total_n", "card_uri", "tag_n"])


PAGED = SCORED + """
, placed AS (SELECT entity_slug, tag_slug, row_number() OVER (ORDER BY z DESC NULLS LAST, tag_n DESC, total_n DESC, entity_slug, tag_slug) - 1 AS position FROM affinity),
paged AS (SELECT *, position // 500 + 1 AS page FROM placed)
"""


def paged(spark, folder):
    rows = analysed(spark, folder)
    return pg.with_page(pg.with_position(rows, sh.leaderboard_order(rows)), STRICT.page_size)


@query("leaderboard_pages", PAGED + "SELECT entity_slug, tag_slug, position, page FROM paged")
def leaderboard_pages(spark, folder):
    return paged(spark, folder).select(*ROW, "position", "page")


@query("page_index", PAGED + """
SELECT page, 'leaderboard/page=' || page AS file, (page - 1) * 500 AS start_row,
  (page - 1) * 500 + count(*) AS end_row, count(*) AS row_count FROM paged GROUP BY page""")
def page_index(spark, folder):
    return pg.page_index(paged(spark, folder), STRICT.page_size)


# The second table page of 25 clean rows in clean order.
@query("entity_page", "WITH " + DIRTY_SQL + """
SELECT entity_slug, source_type, tag_slug, total_n, tag_n FROM clean ORDER BY entity_slug, source_type, tag_slug LIMIT 25 OFFSET 25""")
def entity_page(spark, folder):
    rows = ex.window_of(in_clean_order(cleaned(spark, folder).clean), 25, 25)
    return rows.select("entity_slug", "source_type", "tag_slug", "total_n", "tag_n")


FAMILIES = SCORED + "," + SETS_SQL + """
, sizes AS (SELECT 'entities' AS family, entity_slug AS shard, count(*) AS n FROM affinity GROUP BY ALL UNION ALL SELECT 'tags', tag_slug, count(*) FROM affinity GROUP BY ALL
            UNION ALL SELECT 'sets', code, count(*) FROM affinity JOIN sets USING (entity_slug) GROUP BY ALL)
"""


def families(spark, folder):
    rows = analysed(spark, folder)
    sets = gr.set_rows(rows.join(entities(spark, folder).drop("entity_name"), "entity_slug"), ROW)
    sizes = sh.shard_sizes(rows, "entity_slug", "entities").unionAll(sh.shard_sizes(rows, "tag_slug", "tags")).unionAll(
        sh.shard_sizes(sets, "origin_set_code", "sets"))
    return rows, materialise(sizes)


@query("shard_manifest", FAMILIES + """
SELECT (SELECT count(*) FROM affinity) AS total_rows, (SELECT count(DISTINCT entity_slug) FROM affinity) AS unique_entities,
  (SELECT count(DISTINCT tag_slug) FROM affinity) AS unique_tags,
  (SELECT string_agg(family || ':' || c || ':' || m, '|' ORDER BY family) FROM (SELECT family, count(*) AS c, max(n) AS m FROM sizes GROUP BY family)) AS families""")
def shard_manifest(spark, folder):
    rows, sizes = families(spark, folder)
    one = sh.manifest(rows, sh.shard_statistics(sizes))
    text = F.transform("families", lambda f: F.concat_ws(":", f["family"], f["shard_count"].cast("string"), f["max_rows_in_shard"].cast("string")))
    return one.withColumn("families", joined(text))


# The index of entities names all suppliers and customers' slugs; only suppliers have shards.
@query("shard_check", FAMILIES + """
SELECT 'entities' AS family, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS index_entry_count,
  (SELECT count(*) FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT shard FROM sizes WHERE family = 'entities')) + (SELECT count(*) FROM customer) AS missing_shard_count
UNION ALL SELECT 'tags', (SELECT count(DISTINCT p_brand) FROM part),
  (SELECT count(DISTINCT p_brand) FROM part WHERE lower(replace(p_brand, '#', '-')) NOT IN (SELECT shard FROM sizes WHERE family = 'tags'))""")
def shard_check(spark, folder):
    _, sizes = families(spark, folder)
    index = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug")).unionAll(
        table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    brands = table(spark, folder, "part").select(F.col("p_brand").alias("tag_slug")).distinct()
    return sh.shard_check([("entities", index, "entity_slug", sizes), ("tags", brands, "tag_slug", sizes)])


@query("entity_text_functions", r"""
WITH t AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS bare FROM pages)
SELECT page_id, array_to_string(list_transform(regexp_extract_all(replace(bare, '-', ' '), '[a-zA-Z]+|[^a-zA-Z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS title,
  CASE WHEN trim(regexp_replace(regexp_replace(lower(bare || '_!'), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '-') = '' THEN 'unknown'
       ELSE trim(regexp_replace(regexp_replace(lower(bare || '_!'), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '-') END AS safe,
  trim(regexp_replace(lower(bare || '_!'), '[^a-z0-9]+', '-', 'g'), '-') AS matched, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS searched,
  bare AS shown, bare || ' // B + ' || bare || '|' || bare || '|B + ' || bare || '|' || bare || ' // B' AS candidates, 'https://pages.example/' || trim(bare, '/') || '.json' AS page
FROM t""")
def entity_text_functions(spark, folder):
    rows = table(spark, folder, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("bare"))
    noisy = F.concat("bare", F.lit("_!"))
    pair = F.concat("bare", F.lit(" // B + "), "bare", F.lit("  (commander) "))
    return rows.select(
        "page_id", tx.name_from_slug("bare").alias("title"), tx.safe_slug(noisy).alias("safe"), tx.tag_match_slug(noisy, F.lit("x")).alias("matched"),
        tx.search_text("url").alias("searched"), tx.display_name(F.concat(F.lit("\t"), "bare", F.lit(" (Commander)\n"))).alias("shown"),
        joined(tx.name_candidates(pair)).alias("candidates"),
        tx.page_url("https://pages.example/{slug}.json", F.concat(F.lit(" /"), "bare", F.lit("/"))).alias("page"))
