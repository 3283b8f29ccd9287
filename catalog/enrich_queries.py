"""Enrichment: name ladder, prints, metadata, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.functions.colors import color_label, colors_from_text
from affinis.operators import enrich as en
from affinis.operators.paging import with_position
from affinis.session import materialise
from affinis.sources.identities import first_identities
from catalog.fixtures import PAIRS_SQL, pairs
from catalog.registry import joined, query, table

URI = "struct<normal:string,large:string,small:string,png:string>"


def cards(spark, folder):
    """Cards are the distinct part names; some have a card image, some a face image, some none."""
    name = F.col("card_name")
    size = F.length("card_name") % 4
    distinct = table(spark, folder, "part").groupBy(F.col("p_name").alias("card_name")).agg(F.min("p_partkey").alias("first_part"))
    upper = F.upper("card_name")
    letters = F.array(*[F.lit(x) for x in "GRBUW"])
    none = F.lit(None).cast("string")
    link = F.concat(F.lit("https://img.example/"), F.col("first_part").cast("string"))
    own = F.struct(F.when(size == 0, F.lit("")).otherwise(link).alias("normal"), F.concat(link, F.lit("/large")).alias("large"),
                   none.alias("small"), none.alias("png"))
    face = F.struct(F.struct(none.alias("normal"), none.alias("large"), F.concat(link, F.lit("/small")).alias("small"),
                             none.alias("png")).cast(URI).alias("image_uris"))
    bare = F.struct(F.lit(None).cast(URI).alias("image_uris"))
    return distinct.select(
        "card_name", "first_part", F.concat(F.lit("id-"), F.col("first_part").cast("string")).alias("card_id"),
        F.filter(letters, lambda x: upper.contains(x)).alias("color_identity"),
        F.concat(F.lit("https://cards.example/card/own/"), F.col("first_part").cast("string"), F.lit("/")).alias("card_uri"),
        F.when(size < 2, own).cast(URI).alias("image_uris"),
        F.when(size == 2, F.array(bare, face)).alias("card_faces"),
        F.lit("OWN").alias("set_code"), none.alias("set_name"), none.alias("released_at"), none.alias("set_page_uri"), none.alias("set_uri"),
    )


def prints(spark, folder):
    """Prints are the parts: the brand is the set, the size gives the day; size 50 has no date."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")).cast("string")
    none = F.lit(None).cast("string")
    return table(spark, folder, "part").select(
        F.col("p_name").alias("card_name"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")).alias("set_code"), none.alias("set_name"),
        F.when(F.col("p_size") < 50, day).alias("released_at"), none.alias("set_page_uri"), none.alias("set_uri"))


def named(spark, folder):
    """Suppliers under card names: exact, paired, with a suffix, one sign short, unknown."""
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    one = part.select(F.col("p_partkey").alias("s_suppkey"), F.col("p_name").alias("a"))
    two = part.select((F.col("p_partkey") - 1).alias("s_suppkey"), F.col("p_name").alias("b"))
    both = table(spark, folder, "supplier").select("s_suppkey").join(one, "s_suppkey").join(two, "s_suppkey")
    kind = F.col("s_suppkey") % 5
    name = (
        F.when(kind == 0, F.col("a")).when(kind == 1, F.concat("a", F.lit(" // "), "b"))
        .when(kind == 2, F.concat(F.upper("a"), F.lit(" (Commander)")))
        .when(kind == 3, F.concat(F.substring("a", 1, 2), F.expr("substring(a, 4)")))
        .otherwise(F.concat(F.lit("no such card "), F.col("s_suppkey").cast("string")))
    )
    return both.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug"), name.alias("entity_name"))


FF_SQL = """
cards AS (SELECT p_name AS card_name, min(p_partkey) AS first_part FROM part GROUP BY p_name),
both_names AS (SELECT s_suppkey, a.p_name AS a, b.p_name AS b FROM supplier JOIN part a ON a.p_partkey = s_suppkey JOIN part b ON b.p_partkey = s_suppkey + 1),
named AS (SELECT 's' || s_suppkey AS entity_slug, s_suppkey % 5 AS kind, a, b,
   CASE s_suppkey % 5 WHEN 0 THEN a WHEN 1 THEN a || ' // ' || b WHEN 2 THEN upper(a) || ' (Commander)' WHEN 3 THEN substr(a, 1, 2) || substr(a, 4)
     ELSE 'no such card ' || s_suppkey END AS entity_name FROM both_names),
cand AS (
  SELECT entity_slug, entity_name, 0 AS pos, CASE kind WHEN 2 THEN upper(a) ELSE entity_name END AS candidate FROM named
  UNION ALL SELECT entity_slug, entity_name, 1, a FROM named WHERE kind = 1
  UNION ALL SELECT entity_slug, entity_name, 2, b FROM named WHERE kind = 1 AND a <> b),
exact AS (SELECT c.*, card_name AS exact_card FROM cand c LEFT JOIN cards ON lower(candidate) = lower(card_name)),
dist AS (SELECT candidate, card_name, levenshtein(trim(regexp_replace(lower(candidate), '[^a-z0-9]+', ' ', 'g')),
                                                  trim(regexp_replace(lower(card_name), '[^a-z0-9]+', ' ', 'g'))) AS d
         FROM (SELECT DISTINCT candidate FROM cand) JOIN cards ON true),
near AS (SELECT candidate, any_value(card_name) AS near_card FROM dist q
         WHERE d <= greatest(2, 15 * length(trim(regexp_replace(lower(candidate), '[^a-z0-9]+', ' ', 'g'))) // 100) AND d = (SELECT min(d) FROM dist r WHERE r.candidate = q.candidate)
         GROUP BY candidate HAVING count(*) = 1),
rungs AS (SELECT *, CASE WHEN exact_card IS NOT NULL THEN CASE WHEN pos = 0 THEN 0 ELSE 1 END
                         WHEN near_card IS NOT NULL THEN CASE WHEN pos = 0 THEN 2 ELSE 3 END END AS rung
          FROM exact LEFT JOIN near USING (candidate)),
best AS (SELECT *, min(rung) OVER (PARTITION BY entity_slug) AS best FROM rungs),
matches AS (SELECT entity_name, entity_slug, pos, CASE best WHEN 0 THEN 'exact_full_name' WHEN 1 THEN 'exact_split_parts' WHEN 2 THEN 'fuzzy_full_name'
                     WHEN 3 THEN 'fuzzy_split_parts' ELSE 'not_found' END AS match_strategy,
              CASE WHEN best IS NOT NULL THEN CASE WHEN best < 2 THEN exact_card ELSE near_card END END AS card_name
            FROM best WHERE rung = best OR (best IS NULL AND pos = 0)),
origin AS (SELECT card_name, arg_min(code, (day, code)) AS code, nullif(min(day), '9999-99-99') AS released_at FROM (
             SELECT p_name AS card_name, replace(p_brand, '#', '') AS code,
                    CASE WHEN p_size < 50 THEN strftime(DATE '2000-01-01' + p_size, '%Y-%m-%d') ELSE '9999-99-99' END AS day FROM part) GROUP BY card_name),
detail AS (
  SELECT m.*, c.first_part, lower(o.code) AS code, upper(o.code) AS set_up, o.code AS raw_code, o.released_at,
    CASE length(m.card_name) % 4 WHEN 0 THEN 'https://img.example/' || c.first_part || '/large' WHEN 1 THEN 'https://img.example/' || c.first_part
         WHEN 2 THEN 'https://img.example/' || c.first_part || '/small' END AS image
  FROM matches m LEFT JOIN cards c USING (card_name) LEFT JOIN origin o USING (card_name)),
meta AS (
  SELECT entity_slug, any_value(entity_name) AS entity_name, count(card_name) > 0 AS match_found, any_value(match_strategy) AS match_strategy,
    coalesce(string_agg(card_name, '|' ORDER BY pos), '') AS card_names, coalesce(string_agg('id-' || first_part, '|' ORDER BY pos), '') AS card_ids,
    concat_ws('|', CASE WHEN bool_or(contains(upper(card_name), 'W')) THEN 'W' END, CASE WHEN bool_or(contains(upper(card_name), 'U')) THEN 'U' END,
      CASE WHEN bool_or(contains(upper(card_name), 'B')) THEN 'B' END, CASE WHEN bool_or(contains(upper(card_name), 'R')) THEN 'R' END,
      CASE WHEN bool_or(contains(upper(card_name), 'G')) THEN 'G' END) AS color_identity,
    arg_min(image, pos) FILTER (WHERE image IS NOT NULL) AS card_image_url, coalesce(string_agg(image, '|' ORDER BY pos), '') AS partner_card_image_urls,
    arg_min('https://cards.example/card/own/' || first_part || '/', pos) FILTER (WHERE first_part IS NOT NULL) AS card_uri,
    arg_min(code, pos) FILTER (WHERE code IS NOT NULL) AS origin_set_code, arg_min(set_up, pos) FILTER (WHERE code IS NOT NULL) AS origin_set_name,
    arg_min(coalesce(released_at, '?'), pos) FILTER (WHERE code IS NOT NULL) AS origin_released_at,
    count(DISTINCT code) AS origin_set_count
  FROM detail GROUP BY entity_slug)
"""
WITH = "WITH " + FF_SQL


def matches(spark, folder):
    return en.match_names(named(spark, folder), cards(spark, folder), ["first_part"])


def metadata(spark, folder):
    return en.card_metadata(matches(spark, folder), cards(spark, folder), prints(spark, folder))


@query("name_match", WITH + "SELECT entity_slug, pos, match_strategy, card_name FROM matches")
def name_match(spark, folder):
    return matches(spark, folder).select("entity_slug", "pos", "match_strategy", "card_name")


@query("earliest_print", WITH + "SELECT card_name, lower(code) AS set_code, upper(code) AS set_name, released_at FROM origin")
def earliest_print(spark, folder):
    return en.earliest_prints(prints(spark, folder)).select("card_name", "origin_set.set_code", "origin_set.set_name", "origin_set.released_at")


@query("card_metadata", WITH + "SELECT * FROM meta")
def card_metadata(spark, folder):
    rows = metadata(spark, folder)
    lists = ("card_names", "card_ids", "color_identity", "partner_card_image_urls")
    return rows.select(
        "entity_slug", "entity_name", "match_found", "match_strategy", *[joined(c).alias(c) for c in lists], "card_image_url", "card_uri",
        "origin_set_code", "origin_set_name",
        F.when(F.col("origin_set_code").isNotNull(), F.coalesce("origin_released_at", F.lit("?"))).alias("origin_released_at"),
        F.size("origin_sets").cast("bigint").alias("origin_set_count"))


# Metadata comes twice per entity; the later copy, told by its number, wins.
@query("enriched_rows", WITH + "," + PAIRS_SQL + """
SELECT p.entity_slug, p.tag_slug, p.tag_n, CASE WHEN m.entity_slug IS NULL THEN 'old' ELSE m.card_image_url END AS card_image_url,
  CASE WHEN m.entity_slug IS NULL THEN 'X' ELSE m.color_identity END AS color_identity, m.match_strategy, m.origin_set_code
FROM pairs p LEFT JOIN (SELECT * FROM meta WHERE match_found) m USING (entity_slug)""")
def enriched_rows(spark, folder):
    rows = pairs(spark, folder).select("entity_slug", "tag_slug", "tag_n", F.lit("old").alias("card_image_url"), F.array(F.lit("X")).alias("color_identity"))
    found = materialise(metadata(spark, folder)).where("match_found")
    stale = found.withColumn("card_image_url", F.lit("stale")).withColumn("version", F.lit(1))
    merged = en.merge_metadata(rows, stale.unionByName(found.withColumn("version", F.lit(2))), F.col("version"))
    return merged.select("entity_slug", "tag_slug", "tag_n", "card_image_url", joined("color_identity").alias("color_identity"), "match_strategy", "origin_set_code")


@query("enrichment_summary", WITH + """
SELECT count(*) AS entity_count, count(*) FILTER (WHERE match_found) AS matched_count, count(*) FILTER (WHERE NOT match_found) AS unmatched_count,
  count(card_image_url) AS rows_with_card_image_url, count(*) FILTER (WHERE color_identity <> '') AS rows_with_color_identity,
  count(origin_set_code) AS rows_with_origin_set FROM meta""")
def enrichment_summary(spark, folder):
    return en.enrichment_summary(metadata(spark, folder))


@query("identity_list", "WITH " + PAIRS_SQL + """
SELECT entity_slug, arg_min(CASE WHEN tag_n > 20 THEN entity_name ELSE entity_slug END, tag_slug) AS entity_name FROM pairs GROUP BY entity_slug""")
def identity_list(spark, folder):
    rows = pairs(spark, folder).withColumn("entity_name", F.when(F.col("tag_n") > 20, F.col("entity_name")).otherwise(""))
    blank = rows.withColumn("entity_slug", F.lit(""))
    return en.identities(rows.unionByName(blank), ["tag_slug"])


@query("identity_source_choice", "WITH " + PAIRS_SQL + "SELECT DISTINCT entity_slug, entity_name FROM pairs")
def identity_source_choice(spark, folder):
    """No entity table, an empty one next, then the affinity rows."""
    rows = pairs(spark, folder)
    return first_identities([None, rows.where("entity_slug IS NULL"), rows], [[], ["tag_slug"], ["tag_slug"]])


@query("card_columns", WITH + """
, c AS (SELECT card_name, list_filter(['W', 'U', 'B', 'R', 'G'], lambda x: contains(upper(card_name), x)) AS l FROM cards)
SELECT card_name, array_to_string(l, '') AS colors, CASE array_to_string(l, '') WHEN '' THEN 'Colorless' WHEN 'W' THEN 'W (White)' WHEN 'U' THEN 'U (Blue)'
    WHEN 'B' THEN 'B (Black)' WHEN 'R' THEN 'R (Red)' WHEN 'G' THEN 'G (Green)' WHEN 'WU' THEN 'WU (Azorius)' WHEN 'WB' THEN 'WB (Orzhov)'
    WHEN 'WR' THEN 'WR (Boros)' WHEN 'WG' THEN 'WG (Selesnya)' WHEN 'UB' THEN 'UB (Dimir)' WHEN 'UR' THEN 'UR (Izzet)' WHEN 'UG' THEN 'UG (Simic)'
    WHEN 'BR' THEN 'BR (Rakdos)' WHEN 'BG' THEN 'BG (Golgari)' WHEN 'RG' THEN 'RG (Gruul)' WHEN 'WUB' THEN 'WUB (Esper)' WHEN 'WUR' THEN 'WUR (Jeskai)'
    WHEN 'WUG' THEN 'WUG (Bant)' WHEN 'WBR' THEN 'WBR (Mardu)' WHEN 'WBG' THEN 'WBG (Abzan)' WHEN 'WRG' THEN 'WRG (Naya)' WHEN 'UBR' THEN 'UBR (Grixis)'
    WHEN 'UBG' THEN 'UBG (Sultai)' WHEN 'URG' THEN 'URG (Temur)' WHEN 'BRG' THEN 'BRG (Jund)' WHEN 'WUBR' THEN 'WUBR (Four-colour, no Green)'
    WHEN 'WUBG' THEN 'WUBG (Four-colour, no Red)' WHEN 'WURG' THEN 'WURG (Four-colour, no Black)' WHEN 'WBRG' THEN 'WBRG (Four-colour, no Blue)'
    WHEN 'UBRG' THEN 'UBRG (Four-colour, no White)' ELSE 'WUBRG (Five-colour)' END AS label,
  array_to_string(l, '') AS parsed, CASE length(card_name) % 4 WHEN 0 THEN 'https://img.example/' || first_part || '/large' WHEN 1 THEN 'https://img.example/' || first_part
    WHEN 2 THEN 'https://img.example/' || first_part || '/small' END AS image FROM c JOIN cards USING (card_name)""")
def card_columns(spark, folder):
    rows = cards(spark, folder)
    as_text = F.lower(F.array_join("color_identity", ", "))
    return rows.select(
        "card_name", F.array_join(en.ordered_colors("color_identity"), "").alias("colors"), color_label("color_identity").alias("label"),
        F.array_join(colors_from_text(as_text), "").alias("parsed"), en.card_image("image_uris", "card_faces").alias("image"))


# Names of 20 to 60 signs: a card is three parts and a word that a third of the cards have; a name drops 3 signs and changes up to 3 others.
LONG_SQL = """
parts AS (SELECT row_number() OVER (ORDER BY p_name) AS i, p_name FROM (SELECT DISTINCT p_name FROM part)),
cards AS (SELECT a.i, a.p_name || CASE WHEN a.i % 3 = 0 THEN ' confederation' ELSE ' ' || a.i END || ' of ' || b.p_name AS card_name FROM parts a JOIN parts b ON b.i = a.i % 97 + 1),
names AS (
  SELECT i, CASE i % 4 WHEN 0 THEN c ELSE substr(c, 1, 4) || CASE i % 4 WHEN 1 THEN '' ELSE '0' END || substr(c, 6, 4) || CASE i % 4 WHEN 3 THEN '0' ELSE '' END || substr(c, 11) END AS candidate
  FROM (SELECT i, substr(card_name, 1, length(card_name) - 3) AS c FROM cards)),
dist AS (SELECT n.i, candidate, card_name, levenshtein(lower(candidate), lower(card_name)) AS d FROM names n JOIN cards ON abs(length(candidate) - length(card_name)) <= 9),
near AS (SELECT candidate, card_name, d, min(d) OVER (PARTITION BY candidate) AS least FROM (SELECT DISTINCT candidate, card_name, d FROM dist) WHERE d <= greatest(2, 15 * length(candidate) // 100))
"""


@query("long_name_match", "WITH " + LONG_SQL + """
SELECT candidate, any_value(card_name) AS card_name, any_value(d)::BIGINT AS edits FROM near WHERE d = least GROUP BY candidate HAVING count(*) = 1""")
def long_name_match(spark, folder):
    """The nearest card of every long name, with its distance."""
    distinct = table(spark, folder, "part").select("p_name").distinct()
    numbered = with_position(distinct, [F.col("p_name")], "i").withColumn("i", F.col("i") + 1)
    other = numbered.select((F.col("i") - 1).alias("j"), F.col("p_name").alias("b_name"))
    word = F.when(F.col("i") % 3 == 0, F.lit(" confederation")).otherwise(F.concat(F.lit(" "), F.col("i").cast("string")))
    cards = materialise(numbered.withColumn("j", F.col("i") % 97).join(other, "j").select("i", F.concat("p_name", word, F.lit(" of "), "b_name").alias("card_name")))
    c, kind = F.expr("substring(card_name, 1, length(card_name) - 3)"), F.col("i") % 4
    zero = lambda on: F.when(on, F.lit("0")).otherwise(F.lit(""))
    cut = F.concat(F.substring(c, 1, 4), zero(kind > 1), F.substring(c, 6, 4), zero(kind == 3), F.substring(c, 11, 1000))
    names = cards.select(F.when(kind == 0, c).otherwise(cut).alias("candidate")).distinct()
    found = en.nearest_cards(names, cards.select("card_name"))
    return found.withColumn("edits", F.levenshtein(en.match_text("candidate"), en.match_text("card_name")).cast("bigint"))
