"""Ingest: address slugs, sitemaps, payloads, signal pages, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from affinis.functions.text import page_url
from affinis.operators import cleaning as cl, discovery as dc, signals as sg
from affinis.sources import documents as dm
from affinis.plans.jobs import INGEST_SCHEMA, run_ingest
from affinis.session import materialise, new_path
from affinis.sinks import batches as bt, records as rc
from catalog.fixtures import OBSERVED, PAIRS_SQL, pairs
from catalog.registry import query, rounded, table

HOSTS, PREFIX = ("*.example.com",), "en"
URL_TEMPLATE = "https://pages.example/{slug}.json"


def url_list(spark, folder) -> DataFrame:
    """All page addresses, and all once more with a slash at the end as a second source."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    again = pages.select("page_id", F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/")).alias("url"))
    return pages.withColumn("list_no", F.lit(0)).union(again.withColumn("list_no", F.lit(1)))


URLS_SQL = r"""
urls AS (SELECT page_id, url, 0 AS list_no FROM pages
         UNION ALL SELECT page_id, regexp_extract(url, '^[^?#]*') || '/', 1 FROM pages),
cut AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
          list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM urls),
slugged AS (SELECT *, CASE WHEN suffix(host, '.example.com') AND len(parts) = 2 AND parts[1] = 'en' THEN parts[2] END AS entity_slug FROM cut)
"""


def slugged(spark, folder):
    return dc.with_slug(url_list(spark, folder), "url", HOSTS, PREFIX)


@query("url_slugs", "WITH " + URLS_SQL + """
SELECT entity_slug, arg_min(url, (list_no, page_id)) AS entity_url, 'commanders_sitemap' AS source_type
FROM slugged WHERE entity_slug IS NOT NULL GROUP BY entity_slug""")
def url_slugs(spark, folder):
    rows = dc.index_rows(slugged(spark, folder), "url", F.lit(OBSERVED), ["list_no", "page_id"])
    return dc.dedupe_index(rows).select("entity_slug", "entity_url", "source_type")


@query("invalid_urls", "WITH " + URLS_SQL + "SELECT url FROM slugged WHERE entity_slug IS NULL")
def invalid_urls(spark, folder):
    return dc.invalid_urls(slugged(spark, folder), "url")


@query("duplicate_slugs", "WITH " + URLS_SQL + """
SELECT entity_slug, count(*) AS row_count FROM slugged WHERE entity_slug IS NOT NULL GROUP BY entity_slug HAVING count(*) > 1""")
def duplicate_slugs(spark, folder):
    return dc.duplicate_slugs(dc.index_rows(slugged(spark, folder), "url", F.lit(OBSERVED), ["list_no", "page_id"]))


@query("index_report", "WITH " + URLS_SQL + """
, per AS (SELECT entity_slug, count(*) AS n FROM slugged GROUP BY entity_slug)
SELECT sum(n)::BIGINT AS total_locations_found, coalesce(sum(n) FILTER (WHERE entity_slug IS NOT NULL), 0)::BIGINT AS records_before_deduplication,
  count(entity_slug) AS records_after_deduplication, count(entity_slug) AS unique_slugs,
  count(*) FILTER (WHERE entity_slug IS NOT NULL AND n > 1) AS duplicate_slug_count,
  coalesce(sum(n) FILTER (WHERE entity_slug IS NULL), 0)::BIGINT AS invalid_url_count, 0::BIGINT AS missing_slug_count FROM per""")
def index_report(spark, folder):
    return dc.index_report(slugged(spark, folder))


# One sitemap document per page, in three spellings of the namespace, with a blank location.
@query("sitemap_locations", "SELECT page_id, 0 AS loc_no, url AS loc FROM pages UNION ALL SELECT page_id, 2, url || '/more' FROM pages")
def sitemap_locations(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    url = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def doc(prefix, space):
        tag = f"{prefix}:" if prefix else ""
        return F.concat(F.lit(f"<{tag}urlset {space}><{tag}url><{tag}loc>\n "), url, F.lit(
            f"\n</{tag}loc></{tag}url><{tag}url><{tag}loc> \t</{tag}loc></{tag}url><{tag}url><{tag}loc>"), url, F.lit(
            f"/more</{tag}loc><{tag}priority>1</{tag}priority></{tag}url></{tag}urlset>"))

    space = 'xmlns="http://maps.example/0.9"'
    xml = F.when(F.col("url").startswith("https"), doc("", space)).when(
        F.col("url").contains("?"), doc("m", 'xmlns:m="http://maps.example/0.9"')).otherwise(doc("", ""))
    return dm.sitemap_locations(pages.select("page_id", xml.alias("xml")), "xml")


def payloads(spark, folder) -> DataFrame:
    """One payload document per supplier, built from the pairs, in good and bad shapes."""
    one = pairs(spark, folder).groupBy("entity_slug").agg(
        F.max("total_n").alias("total_n"),
        F.array_sort(F.collect_list(F.struct(F.col("tag_n").alias("count"), F.col("tag_slug").alias("slug"),
                                             F.col("tag_name").alias("value")))).alias("links"))
    kind = F.substring("entity_slug", 2, 20).cast("bigint") % 10
    total = F.col("total_n").cast("string")
    comma = F.concat(F.lit('"1,'), F.lpad(total, 3, "0"), F.lit('"'))
    count = (F.when(kind == 1, comma).when(kind == 2, "true").when(kind == 3, '"many"').otherwise(total))
    new = F.concat(F.lit('"container":{"json_dict":{"card":{"num_decks":'), count, F.lit("}}},"))
    old = F.concat(F.lit('"num_decks_avg":'), total, F.lit(","))
    links = F.to_json("links")
    panels = (F.when(kind == 4, F.lit('"panels":{}')).when(kind == 5, F.lit('"panels":{"taglinks":{"a":1}}'))
              .otherwise(F.concat(F.lit('"panels":{"taglinks":'), links, F.lit("}"))))
    name = (F.when(kind == 6, '"header":{"title":" Titled "},').when(kind == 7, '"name":" Named ","header":"Head",')
            .when(kind == 8, '"header":"Head",').otherwise(""))
    body = F.concat(F.lit("{"), F.when(kind == 0, old).when(kind == 3, F.concat(new, old)).otherwise(new), name, panels, F.lit("}"))
    return one.select("entity_slug", F.when(kind == 9, F.concat(F.lit("x"), body)).otherwise(body).alias("body"))


PAYLOAD_SQL = "WITH " + PAIRS_SQL + ", kinds AS (SELECT *, substr(entity_slug, 2)::BIGINT % 10 AS kind FROM pairs)"


def parsed(spark, folder):
    return dm.read_payloads(payloads(spark, folder))


@query("payload_rows", PAYLOAD_SQL + f"""
SELECT CASE kind WHEN 6 THEN 'Titled' WHEN 7 THEN 'Named' WHEN 8 THEN 'Head' ELSE upper(entity_slug) END AS entity_name, entity_slug,
  CASE WHEN kind = 1 THEN 1000 + total_n ELSE total_n END AS total_n, tag_name, tag_slug, tag_n, source_type, observed_at
FROM kinds WHERE kind IN (0, 1, 6, 7, 8)""")
def payload_rows(spark, folder):
    return dm.payload_rows(parsed(spark, folder), F.lit(OBSERVED)).drop("tag_no")


@query("payload_failures", PAYLOAD_SQL + f"""
SELECT DISTINCT entity_slug, 'https://pages.example/' || entity_slug || '.json' AS url,
  CASE kind WHEN 2 THEN 'ValueError' WHEN 3 THEN 'ValueError' WHEN 4 THEN 'KeyError' WHEN 5 THEN 'TypeError' ELSE 'JSONDecodeError' END AS error_type,
  CASE kind WHEN 2 THEN 'page count' WHEN 3 THEN 'page count' WHEN 9 THEN 'body is no JSON' ELSE 'panels.taglinks' END AS error_message,
  '{OBSERVED}' AS observed_at FROM kinds WHERE kind IN (2, 3, 4, 5, 9)""")
def payload_failures(spark, folder):
    return dm.payload_failures(parsed(spark, folder), page_url(URL_TEMPLATE, "entity_slug"), F.lit(OBSERVED))


def signal_inputs(spark, folder):
    """Index, normal rows and landed responses: the page of a supplier gives its Brand#1 count;
    overdrawn suppliers have no normal rows."""
    rows = materialise(pairs(spark, folder))
    number = F.substring("entity_slug", 2, 20).cast("bigint")
    per_entity = rows.groupBy("entity_slug").agg(
        F.max("total_n").alias("n"), F.coalesce(F.max(F.when(F.col("tag_slug") == "brand-1", F.col("tag_n"))), F.lit(0)).alias("signal_n"))
    kind = number % 13
    status = F.when(kind == 1, 404).when(kind == 2, 500).when(kind != 3, 200)
    shown = F.when(kind == 4, F.lit(0)).when(kind == 5, F.col("n") + 1).otherwise(F.col("signal_n"))
    body = F.when(kind == 6, F.lit("<html>")).otherwise(
        F.concat(F.lit('{"container":{"json_dict":{"card":{"num_decks":'), shown.cast("string"), F.lit("}}}}")))
    responses = per_entity.select("entity_slug", status.alias("http_status"), F.when(kind == 3, F.lit("timeout")).alias("transport_error"), body.alias("body"))
    index = table(spark, folder, "supplier").select(
        F.when(F.col("s_suppkey") % 13 == 7, F.lit(" ")).otherwise(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("entity_slug"))
    overdrawn = table(spark, folder, "supplier").where("s_acctbal < 0").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug"))
    normal = rows.join(overdrawn, "entity_slug", "left_anti")
    return index, normal, responses


SIGNAL_SQL = "WITH " + PAIRS_SQL + """,
per AS (SELECT entity_slug, max(total_n) AS n, coalesce(max(tag_n) FILTER (WHERE tag_slug = 'brand-1'), 0) AS signal_n FROM pairs GROUP BY entity_slug),
outcome AS (
  SELECT CASE WHEN s_suppkey % 13 = 7 THEN '' ELSE 's' || s_suppkey END AS entity_slug, n, signal_n,
    CASE WHEN s_suppkey % 13 = 7 THEN 'invalid_commander_index_record' WHEN s_acctbal < 0 OR n IS NULL THEN 'missing_normal_metadata'
      WHEN s_suppkey % 13 = 1 THEN 'no_cedh_route' WHEN s_suppkey % 13 = 2 THEN 'http_error' WHEN s_suppkey % 13 = 3 THEN 'request_error'
      WHEN s_suppkey % 13 = 4 OR (signal_n = 0 AND s_suppkey % 13 NOT IN (5, 6)) THEN 'no_cedh_decks'
      WHEN s_suppkey % 13 IN (5, 6) THEN 'parse_error' ELSE 'cedh_row_written' END AS status_type
  FROM supplier LEFT JOIN per ON entity_slug = 's' || s_suppkey)
"""


def outcome(spark, folder):
    index, normal, responses = signal_inputs(spark, folder)
    return sg.classify_responses(index, sg.normal_metadata(normal, ["tag_slug"]), responses, F.lit(OBSERVED))


@query("signal_status", SIGNAL_SQL + """
SELECT entity_slug, CASE WHEN entity_slug <> '' THEN 'https://pages.example/' || entity_slug || '.json' END AS url, status_type,
  CASE status_type WHEN 'no_cedh_route' THEN 404 WHEN 'http_error' THEN 500 END AS http_status_code,
  CASE WHEN status_type = 'cedh_row_written' THEN signal_n END AS tag_n FROM outcome""")
def signal_status(spark, folder):
    return sg.status_rows(outcome(spark, folder), page_url(URL_TEMPLATE, "entity_slug")).drop("reason", "observed_at")


@query("signal_rows", SIGNAL_SQL + f"""
SELECT 'Supplier ' || entity_slug AS entity_name, entity_slug, n AS total_n, 'cEDH' AS tag_name, 'cedh' AS tag_slug, signal_n AS tag_n,
  'cedh_filtered_json' AS source_type, '{OBSERVED}' AS observed_at FROM outcome WHERE status_type = 'cedh_row_written'""")
def signal_rows(spark, folder):
    return sg.signal_rows(outcome(spark, folder))


@query("status_counts", SIGNAL_SQL + """
SELECT CASE WHEN status_type = 'no_cedh_decks' THEN 'unknown' ELSE status_type END AS status_type, count(*) AS row_count FROM outcome GROUP BY ALL""")
def status_counts(spark, folder):
    """Statuses counted, with one of them blanked to show how a missing status is counted."""
    rows = outcome(spark, folder).withColumn(
        "status_type", F.when(F.col("status_type") == sg.NO_ROWS, F.lit("  ")).otherwise(F.col("status_type")))
    return cl.status_counts(rows)


# Done: entities with a signal row or any status but a request error.
@query("resume_pending", SIGNAL_SQL + """
SELECT DISTINCT 's' || s_suppkey AS entity_slug FROM supplier
WHERE 's' || s_suppkey NOT IN (SELECT entity_slug FROM outcome WHERE status_type <> 'request_error')""")
def resume_pending(spark, folder):
    result = outcome(spark, folder)
    done = dc.done_slugs(sg.signal_rows(result), result.where(F.col("status_type") != sg.REQUEST_ERROR))
    index = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug"))
    return dc.pending(index, done)


# Entities of overdrawn suppliers, and those that an earlier run has a status of (every fifth), are done and are not attempted again.
@query("signal_summary", SIGNAL_SQL + """
, done AS (SELECT 's' || s_suppkey AS entity_slug FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 5 = 0),
todo AS (SELECT * FROM outcome WHERE entity_slug NOT IN (SELECT entity_slug FROM done))
SELECT (SELECT count(*) FROM outcome) AS total_records_in_index, (SELECT count(*) FROM outcome WHERE entity_slug IN (SELECT entity_slug FROM done)) AS skipped_count,
  count(*) FILTER (WHERE entity_slug <> '') AS attempted_count,
  count(*) FILTER (WHERE status_type = 'cedh_row_written') AS signal_row_count,
  count(*) FILTER (WHERE status_type IN ('no_cedh_route', 'no_cedh_decks')) AS no_signal_count,
  count(*) FILTER (WHERE status_type = 'missing_normal_metadata') AS missing_metadata_count,
  count(*) FILTER (WHERE status_type IN ('invalid_commander_index_record', 'http_error', 'request_error', 'parse_error')) AS error_count FROM todo""")
def signal_summary(spark, folder):
    index, normal, responses = signal_inputs(spark, folder)
    supplier = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug"), "s_acctbal", "s_suppkey")
    done = dc.done_slugs(supplier.where("s_acctbal < 0"), supplier.where("s_suppkey % 5 = 0"))
    result = sg.classify_responses(dc.pending(index, done), sg.normal_metadata(normal, ["tag_slug"]), responses, F.lit(OBSERVED))
    return sg.signal_summary(index, done, result)


# Entities of overdrawn suppliers count as done by an earlier run.
@query("ingest_summary", PAYLOAD_SQL + """
, done AS (SELECT 's' || s_suppkey AS entity_slug FROM supplier WHERE s_acctbal < 0),
todo AS (SELECT k.* FROM kinds k WHERE entity_slug NOT IN (SELECT entity_slug FROM done))
SELECT (SELECT count(*) FROM supplier) AS total_records_in_index, (SELECT count(*) FROM done) AS skipped_count,
  count(DISTINCT entity_slug) AS attempted_count, count(DISTINCT entity_slug) FILTER (WHERE kind IN (0, 1, 6, 7, 8)) AS successful_count,
  count(DISTINCT entity_slug) FILTER (WHERE kind IN (2, 3, 4, 5, 9)) AS failed_count,
  count(*) FILTER (WHERE kind IN (0, 1, 6, 7, 8)) AS new_tag_row_count FROM todo""")
def ingest_summary(spark, folder):
    supplier = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug"), "s_acctbal")
    index = supplier.select("entity_slug")
    done = dc.done_slugs(supplier.where("s_acctbal < 0"))
    pages = dc.pending(payloads(spark, folder), done)
    return dc.ingest_summary(index, done, dm.read_payloads(pages))


@query("trial_limit", "SELECT 's' || s_suppkey AS entity_slug, s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 7")
def trial_limit(spark, folder):
    index = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug"), "s_suppkey")
    return dc.first_entities(index, 7, ["s_suppkey"])


# Three large files, one element a line: a plain sitemap, one with a prefix, and an index of sitemaps.
@query("large_sitemap", """
SELECT kind, url || CASE kind WHEN 'index' THEN '/map.xml' ELSE '' END AS loc FROM pages, (VALUES ('plain'), ('prefixed'), ('index')) k(kind)""")
def large_sitemap(spark, folder):
    """Every location of every file, read in splits."""
    out = new_path(spark, "sitemaps")
    url = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    kinds = {"plain": ("", "urlset", "url", ""), "prefixed": ("m:", "urlset", "url", ":m"), "index": ("", "sitemapindex", "sitemap", "")}
    result = None
    for kind, (p, root, item, space) in kinds.items():
        loc = F.concat(url, F.lit("/map.xml")) if kind == "index" else url
        lines = table(spark, folder, "pages").select(F.col("page_id").alias("no"), F.concat(
            F.lit(f"<{p}{item}><{p}loc>\n "), loc, F.lit(f" </{p}loc><{p}lastmod>2026-05-07</{p}lastmod><{p}note/></{p}{item}>")).alias("value"))
        ends = spark.createDataFrame([(-1, f'<?xml version="1.0"?><!-- made --><{p}{root} xmlns{space}="http://maps.example/0.9">'), (1 << 60, f"</{p}{root}>")], "no bigint, value string")
        # one file: that is what is tested
        lines.unionByName(ends).repartitionByRange(1, "no").sortWithinPartitions("no").select("value").write.text(f"{out}/{kind}")
        one = dm.read_large_sitemap(spark, f"{out}/{kind}").select(F.lit(kind).alias("kind"), "loc")
        result = one if result is None else result.unionAll(one)
    return result


# The pages of half of the suppliers come first; the second batch fails once with half of its rows written, and is then run twice.
@query("ingest_batches", PAYLOAD_SQL + """
SELECT batch, entity_slug, tag_slug, CASE kind WHEN 1 THEN 1000 + total_n ELSE total_n END AS total_n, tag_n
FROM (SELECT *, CASE WHEN substr(entity_slug, 2)::BIGINT % 20 < 10 THEN 'first' ELSE 'second' END AS batch FROM kinds) WHERE kind IN (0, 1, 6, 7, 8)""")
def ingest_batches(spark, folder):
    """Rows of an ingest in batches, none twice and none lost, with the batch that each came in."""
    out = new_path(spark, "ingest")
    index = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_slug"))
    pages = materialise(payloads(spark, folder))
    early = F.substring("entity_slug", 2, 20).cast("bigint") % 20 < 10
    url = page_url(URL_TEMPLATE, "entity_slug")
    run_ingest(index, pages.where(early), out, "first", F.lit(OBSERVED), url)
    half = dm.payload_rows(dm.read_payloads(pages.where(~early)), F.lit(OBSERVED)).drop("tag_no").where("tag_n % 2 = 0")
    rc.write_records(half, f"{out}/tag_rows/batch=second")  # a run that ended before its batch was committed
    for _ in range(2):
        run_ingest(index, pages, out, "second", F.lit(OBSERVED), url)
    rows = bt.read_batches(spark, f"{out}/tag_rows", INGEST_SCHEMA)
    batch = F.regexp_extract(F.col("_metadata.file_path"), "batch=([^/]*)", 1)
    return rows.select(batch.alias("batch"), "entity_slug", "tag_slug", "total_n", "tag_n")
