"""Origin sets, tiers and themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions.origin_sets import belongs_to_set, selected_set, set_labels, sets_of_row
from affinis.functions.lists import list_from_text
from affinis.operators import affinity as af, explore as ex, groups as gr, tiers as ti
from affinis.session import materialise
from catalog.fixtures import PAIRS_SQL, SIGNALS, STRICT, affinity_sql, pairs
from catalog.registry import joined, query, rounded, table

SCORED = "WITH " + PAIRS_SQL + "," + affinity_sql()
ROW = ("entity_slug", "tag_slug")


def entities(spark, folder):
    """Suppliers with their nation as origin set: in a list with a second set, in flat columns, or only in an address."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    code = F.concat(F.lit("n"), n.cast("string"))
    other = F.concat(F.lit(" N"), ((n + 7) % 25).cast("string"))
    day = F.when(n % 2 == 0, F.concat(F.lit("20"), F.lpad(n.cast("string"), 2, "0"), F.lit("-01-01")))
    by_uri, by_list = k % 5 == 0, k % 3 == 0
    none = F.lit(None).cast("string")
    element = F.array(
        F.struct(code.alias("code"), F.col("n_name").alias("name"), day.alias("released_at"), none.alias("set_code")),
        F.struct(none.alias("code"), none.alias("name"), none.alias("released_at"), other.alias("set_code")),
        F.struct(none.alias("code"), F.lit("no code").alias("name"), none.alias("released_at"), none.alias("set_code")))
    flat = ~by_uri & ~by_list
    return supplier.join(nation, "s_nationkey").select(
        F.concat(F.lit("s"), k.cast("string")).alias("entity_slug"), F.concat(F.lit("Supplier s"), k.cast("string")).alias("entity_name"),
        F.when(~by_uri & by_list, element).alias("origin_sets"),
        F.when(flat, code).alias("origin_set_code"), F.when(flat, F.col("n_name")).alias("origin_set_name"), F.when(flat, day).alias("origin_released_at"),
        F.when(by_uri, F.concat(F.lit("https://cards.example/card/N"), n.cast("string"), F.lit("/1/x"))).alias("card_uri"))


SETS_SQL = """
own AS (SELECT 's' || s_suppkey AS entity_slug, s_suppkey AS k, s_nationkey AS n, n_name,
          CASE WHEN s_nationkey % 2 = 0 THEN '20' || lpad(s_nationkey::VARCHAR, 2, '0') || '-01-01' END AS day FROM supplier JOIN nation ON n_nationkey = s_nationkey),
sets AS (SELECT entity_slug, 0 AS pos, 'n' || n AS code, CASE WHEN k % 5 = 0 THEN 'N' || n ELSE n_name END AS set_name, CASE WHEN k % 5 <> 0 THEN day END AS released_at FROM own
         UNION ALL SELECT entity_slug, 1, 'n' || ((n + 7) % 25), 'N' || ((n + 7) % 25), NULL FROM own WHERE k % 5 <> 0 AND k % 3 = 0)
"""
WITH = SCORED + "," + SETS_SQL


def analysed(spark, folder):
    return materialise(af.analyse(materialise(pairs(spark, folder)), STRICT, check=False))


def enriched(spark, folder):
    return analysed(spark, folder).join(entities(spark, folder).drop("entity_name"), "entity_slug")


@query("origin_set_columns", "WITH " + SETS_SQL + """
SELECT entity_slug, string_agg(code, '|' ORDER BY pos) AS codes, string_agg(set_name, ', ' ORDER BY pos) AS labels, arg_min(code, pos) AS origin_set_code,
  arg_min(set_name, pos) AS origin_set_name, arg_min(coalesce(released_at, '?'), pos) AS origin_released_at, bool_or(code = 'n7') AS in_n7,
  max(set_name) FILTER (WHERE code = 'n7') AS n7_name, string_agg(code, '|' ORDER BY pos) AS reread FROM sets GROUP BY entity_slug""")
def origin_set_columns(spark, folder):
    rows = gr.with_origin_sets(entities(spark, folder))
    codes = F.transform("origin_sets", lambda s: s["set_code"])
    as_json, as_list = F.to_json(codes), F.array_join(codes, " , ")
    reread = F.when(F.size(codes) > 1, list_from_text(as_json)).otherwise(list_from_text(as_list))
    return rows.select(
        "entity_slug", joined(codes).alias("codes"), set_labels("origin_sets").alias("labels"), "origin_set_code", "origin_set_name",
        F.coalesce("origin_released_at", F.lit("?")).alias("origin_released_at"), belongs_to_set("origin_sets", "N7").alias("in_n7"),
        selected_set("origin_sets", "n7")["set_name"].alias("n7_name"), joined(reread).alias("reread"))


@query("set_rows", WITH + """
SELECT a.entity_slug, a.tag_slug, a.total_n, a.tag_n, round(a.z, 6) AS z, a.rank_within_tag_by_z, s.code AS origin_set_code, s.set_name AS origin_set_name,
  s.released_at AS origin_released_at FROM affinity a JOIN sets s USING (entity_slug)""")
def set_rows(spark, folder):
    rows = gr.in_set_order(gr.set_rows(enriched(spark, folder), ROW))
    return rounded(rows.select(*ROW, "total_n", "tag_n", "z", "rank_within_tag_by_z", "origin_set_code", "origin_set_name", "origin_released_at"))


SET_INDEX = """
SELECT code AS set_code, arg_min(set_name, place) AS set_name, arg_min(released_at, place) FILTER (WHERE released_at IS NOT NULL) AS released_at,
  {count} AS entity_count{rows}, 'sets/shard=' || code AS file FROM placed GROUP BY code"""


@query("set_index", WITH + ", placed AS (SELECT s.*, (a.entity_slug, a.tag_slug, s.pos) AS place FROM affinity a JOIN sets s USING (entity_slug))"
       + SET_INDEX.format(count="count(DISTINCT entity_slug)", rows=", count(*) AS row_count"))
def set_index(spark, folder):
    return gr.set_index(gr.set_rows(enriched(spark, folder), ROW)).drop("set_page_uri", "set_uri")


@query("set_index_from_entities", "WITH " + SETS_SQL + ", placed AS (SELECT *, (entity_slug, pos) AS place FROM sets)"
       + SET_INDEX.format(count="count(*)", rows=""))
def set_index_from_entities(spark, folder):
    return gr.set_index_of_entities(entities(spark, folder), ["entity_slug"]).drop("set_page_uri", "set_uri")


@query("entities_of_set", "WITH " + SETS_SQL + """
SELECT entity_slug, code AS origin_set_code, set_name AS origin_set_name, released_at AS origin_released_at FROM sets WHERE code = 'n7'""")
def entities_of_set(spark, folder):
    return gr.entities_of_set(entities(spark, folder), "N7").select("entity_slug", "origin_set_code", "origin_set_name", "origin_released_at")


# Entity rows of one set without tag figures become the affinity rows of their entities.
@query("set_expand_detail", WITH + """
SELECT a.entity_slug, a.tag_slug, a.tag_n, s.code AS origin_set_code, s.set_name AS origin_set_name, s.released_at AS origin_released_at
FROM sets s JOIN affinity a USING (entity_slug) WHERE s.code = 'n7'""")
def set_expand_detail(spark, folder):
    base = gr.entities_of_set(entities(spark, folder), "n7")
    details = analysed(spark, folder)
    rows = gr.expand_set_rows(base, details, "N7", ["entity_slug"], keep_unexpanded=False)
    return rows.select(*ROW, "tag_n", "origin_set_code", "origin_set_name", "origin_released_at")


# Here only the rows of well-scored tags count as details, so some entities keep their own row.
@query("set_expand_keep", WITH + """
SELECT s.entity_slug, a.tag_slug, a.tag_n, s.code AS origin_set_code, s.set_name AS origin_set_name
FROM sets s LEFT JOIN (SELECT * FROM affinity WHERE z > 2.2) a USING (entity_slug) WHERE s.code = 'n7'""")
def set_expand_keep(spark, folder):
    base = gr.entities_of_set(entities(spark, folder), "n7")
    details = analysed(spark, folder).where("z > 2.2")
    rows = gr.expand_set_rows(base, details, "n7", ["entity_slug"], keep_unexpanded=True)
    return rows.select(*ROW, "tag_n", "origin_set_code", "origin_set_name")


TIER_SQL = """
lead AS (SELECT entity_slug, z, tag_name, tag_slug, tag_n FROM affinity WHERE tag_slug = 'brand-1'),
arch AS (SELECT * FROM (SELECT entity_slug, z, tag_name, tag_slug, tag_n, row_number() OVER (PARTITION BY entity_slug ORDER BY z DESC, tag_slug) AS r
                        FROM affinity WHERE tag_slug IN ('brand-2', 'brand-3', 'brand-4', 'brand-5', 'brand-6') AND z IS NOT NULL) WHERE r = 1),
tiers AS (
  SELECT e.entity_slug, e.entity_name, e.total_n,
    CASE WHEN l.z >= 1.05 THEN '5' WHEN l.z > 0.95 THEN '4/5' WHEN l.z >= 0.05 THEN '4' WHEN a.z >= 1.05 THEN '3' WHEN a.z > 0.95 THEN '2/3'
         WHEN a.z >= 0.05 THEN '2' WHEN a.z > 0 THEN '1/2' ELSE '1' END AS bracket_key,
    CASE WHEN l.z >= 1.05 THEN 5.0 WHEN l.z > 0.95 THEN 4.5 WHEN l.z >= 0.05 THEN 4.0 WHEN a.z >= 1.05 THEN 3.0 WHEN a.z > 0.95 THEN 2.5
         WHEN a.z >= 0.05 THEN 2.0 WHEN a.z > 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS bracket_rank,
    CASE WHEN l.z >= 0.05 THEN l.tag_name ELSE a.tag_name END AS decision_tag_name, CASE WHEN l.z >= 0.05 THEN l.tag_slug ELSE a.tag_slug END AS decision_tag_slug,
    round(CASE WHEN l.z >= 0.05 THEN l.z ELSE a.z END, 6) AS decision_z, CASE WHEN l.z >= 0.05 THEN l.tag_n ELSE a.tag_n END AS decision_tag_n
  FROM (SELECT DISTINCT entity_slug, entity_name, total_n FROM affinity) e LEFT JOIN lead l USING (entity_slug) LEFT JOIN arch a USING (entity_slug))
"""
TIERS = WITH + "," + TIER_SQL
TIER_OUT = ("bracket_key", "bracket_rank", "decision_tag_name", "decision_tag_slug", "decision_z", "decision_tag_n")


def set_tiers(spark, folder):
    rows = gr.set_rows(enriched(spark, folder), ROW)
    return ti.tier_rows(rows, ["set_place"], by=["origin_set_code"], signals=SIGNALS)


@query("tiers_by_set", TIERS + """
SELECT s.code AS origin_set_code, t.entity_slug, t.total_n, t.bracket_key, t.bracket_rank, t.decision_tag_name, t.decision_tag_slug, t.decision_z, t.decision_tag_n
FROM tiers t JOIN sets s USING (entity_slug)""")
def tiers_by_set(spark, folder):
    return rounded(set_tiers(spark, folder).select("origin_set_code", "entity_slug", "total_n", *TIER_OUT))


@query("entity_tiers", TIERS + """
SELECT entity_slug, entity_name, bracket_key, 'Bracket ' || bracket_key AS bracket_label, bracket_rank, decision_tag_slug, decision_z,
  CASE bracket_key WHEN '5' THEN 'Brand#1 z-score is at least 1.05.' WHEN '4/5' THEN 'Brand#1 z-score is between 0.95 and 1.05.'
    WHEN '4' THEN 'Brand#1 z-score is from 0.05 through 0.95.' WHEN '3' THEN decision_tag_name || ' z-score is at least 1.05.'
    WHEN '2/3' THEN decision_tag_name || ' z-score is between 0.95 and 1.05.' WHEN '2' THEN decision_tag_name || ' z-score is from 0.05 through 0.95.'
    WHEN '1/2' THEN decision_tag_name || ' z-score is positive but below 0.05.' ELSE 'No Brand#1 or archetype tag reaches a higher bracket threshold.' END AS bracket_reason
FROM tiers""")
def entity_tiers(spark, folder):
    rows = ti.tier_rows(analysed(spark, folder), ["tag_slug"], signals=SIGNALS)
    return rounded(rows.select("entity_slug", "entity_name", "bracket_key", "bracket_label", "bracket_rank", "decision_tag_slug", "decision_z", "bracket_reason"))


TIER_LIST = "(VALUES ('5'), ('4/5'), ('4'), ('3'), ('2/3'), ('2'), ('1/2'), ('1')) k(bracket_key)"


# Entities with 450 in total and 20 for the deciding tag, counted per set and tier.
@query("tier_counts", TIERS + f"""
, f AS (SELECT s.code, t.bracket_key FROM tiers t JOIN sets s USING (entity_slug) WHERE total_n >= 450 AND decision_tag_n >= 20)
SELECT c.code AS origin_set_code, k.bracket_key, count(f.code) AS entity_count FROM (SELECT DISTINCT code FROM f) c CROSS JOIN {TIER_LIST}
LEFT JOIN f ON f.code = c.code AND f.bracket_key = k.bracket_key GROUP BY ALL""")
def tier_counts(spark, folder):
    chosen = ex.filter_tiers(set_tiers(spark, folder), min_total_n=450, min_decks=20)
    return ti.tier_counts(chosen, ["origin_set_code"])


@query("tier_filter", TIERS + """
SELECT s.code AS origin_set_code, t.entity_slug, t.bracket_key, t.decision_tag_n FROM tiers t JOIN sets s USING (entity_slug)
WHERE total_n >= 450 AND decision_tag_n >= 20 AND bracket_key = '3'
  AND (contains(replace(lower(entity_name), ' ', ''), 's1') OR contains(lower(entity_slug), 's1') OR contains(regexp_replace(lower(decision_tag_name), '[^a-z0-9]+', '', 'g'), 's1'))""")
def tier_filter(spark, folder):
    chosen = ex.filter_tiers(set_tiers(spark, folder), query="S1", min_total_n=450, min_decks=20, tier="3")
    return ex.sort_rows(chosen, "bracket_rank", ties=["entity_slug"]).select("origin_set_code", "entity_slug", "bracket_key", "decision_tag_n")


IN_SIGNALS = "tag_slug IN ('brand-1', 'brand-2', 'brand-3', 'brand-4', 'brand-5', 'brand-6')"


@query("theme_rows", SCORED + f"""
, sig AS (SELECT entity_slug, string_agg(tag_slug || ':' || tag_n, '|' ORDER BY tag_slug) AS bracket_tags, count(*) AS bracket_tag_count FROM affinity WHERE {IN_SIGNALS} GROUP BY entity_slug)
SELECT entity_name, entity_slug, total_n, tag_name AS theme_tag_name, tag_slug AS theme_tag_slug, round(z, 6) AS theme_z, tag_n AS theme_tag_n,
  round(tag_affinity_pct, 6) AS theme_affinity_pct, rank_within_tag_by_z AS theme_rank_within_tag_by_z, coalesce(bracket_tags, '') AS bracket_tags, coalesce(bracket_tag_count, 0) AS bracket_tag_count
FROM affinity LEFT JOIN sig USING (entity_slug) WHERE {IN_SIGNALS} OR z >= 1.05""")
def theme_rows(spark, folder):
    rows = ti.theme_rows(analysed(spark, folder), STRICT)
    tags = F.transform("bracket_tag_rows", lambda r: F.concat(r["tag_slug"], F.lit(":"), r["tag_n"].cast("string")))
    return rounded(rows.withColumn("bracket_tags", joined(tags)).withColumn("bracket_tag_count", F.size(tags).cast("bigint")).drop("bracket_tag_rows"))


@query("theme_index", SCORED + f"""
SELECT tag_slug, tag_name, count(*) AS tag_row_count, round(max(z), 6) AS max_z,
  count(DISTINCT entity_slug) FILTER (WHERE {IN_SIGNALS} OR z >= 1.05) AS qualified_entity_count,
  CASE WHEN {IN_SIGNALS} THEN NULL ELSE 1.05 END::DOUBLE AS minimum_z, CASE WHEN {IN_SIGNALS} THEN 'bracket_rules_only' ELSE 'theme_z_and_bracket_rules' END AS qualification_rule,
  'theme-brackets/shard=' || tag_slug AS file FROM affinity GROUP BY tag_slug, tag_name""")
def theme_index(spark, folder):
    rows = analysed(spark, folder)
    summary = af.tag_summary(rows).select("tag_slug", "tag_name", "tag_row_count", "max_z")
    return rounded(ti.theme_index(rows, ROW, summary, STRICT))


THEME_TIERS = TIERS + f"""
, themed AS (SELECT a.entity_slug, a.tag_slug AS theme_tag_slug, a.tag_name AS theme_tag_name, round(a.z, 6) AS theme_z, a.tag_n AS theme_tag_n, a.total_n,
    t.bracket_key, t.bracket_rank, t.decision_tag_name, t.decision_tag_slug, t.decision_z, t.decision_tag_n
  FROM affinity a JOIN tiers t USING (entity_slug) WHERE {IN_SIGNALS.replace('tag_slug', 'a.tag_slug')} OR a.z >= 1.05)
"""


@query("tiers_by_theme", THEME_TIERS + "SELECT * EXCLUDE total_n FROM themed")
def tiers_by_theme(spark, folder):
    rows = materialise(ti.theme_rows(analysed(spark, folder), STRICT))
    tiers = ti.theme_tier_rows(rows, ["entity_slug"], signals=SIGNALS)
    return rounded(tiers.select("entity_slug", "theme_tag_slug", "theme_tag_name", "theme_z", "theme_tag_n", *TIER_OUT))


# The theme page over flat rows of all tags, as when no theme table is at hand.
@query("tiers_of_one_theme", THEME_TIERS + """
SELECT entity_slug, theme_tag_slug, theme_tag_name, theme_z, theme_tag_n, bracket_key, bracket_rank, decision_tag_name, decision_tag_slug, decision_z, decision_tag_n
FROM themed WHERE theme_tag_slug = 'brand-11' AND theme_tag_n >= 20 AND total_n >= 200""")
def tiers_of_one_theme(spark, folder):
    tiers = ti.theme_tier_rows(analysed(spark, folder), ["tag_slug"], theme="Brand 11", signals=SIGNALS)
    chosen = ex.filter_tiers(tiers, min_decks=20, decks="theme_tag_n")
    return rounded(ex.sort_rows(chosen, "theme_z", ties=["entity_slug"]).select("entity_slug", "theme_tag_slug", "theme_tag_name", "theme_z", "theme_tag_n", *TIER_OUT))
