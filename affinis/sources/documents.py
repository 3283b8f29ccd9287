"""Landed documents: sitemaps and page payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affinis.config import NORMAL_SOURCE
from affinis.functions import payload as pl
from affinis.functions.text import bind, strip

_LOCATIONS = "//*[local-name()='loc']/text()[1]"


def sitemap_locations(docs: DataFrame, xml: str) -> DataFrame:
    """One row per non-blank location of each sitemap document, with its place in it.

    Namespaces do not matter; a document that is no XML fails the job.
    """
    others = [c for c in docs.columns if c != xml]
    found = docs.select(*others, F.posexplode(F.xpath(F.col(xml), F.lit(_LOCATIONS))).alias("loc_no", "loc"))
    return found.withColumn("loc", strip("loc")).where("loc <> ''")


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Locations of all sitemap files under a path, a file being one document."""
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return sitemap_locations(docs, "value")


# Pieces of a sitemap file between two "<" signs: name of a tag with its sign of closing, and the text behind the tag.
_TAG = r"(?s)^(/?)(?:[\w.\-]+:)?([\w.\-]+)[^>]*?(/?)>(.*)$"


def read_large_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Locations of one large sitemap or sitemap index, read in splits: the file is cut at every "<", and a piece that opens an element whose local
    name is `loc` holds its text. A file with unequal numbers of opened and closed elements, a tag without an end, or CDATA or comments
    with tags in them, which a split cannot tell from elements, is an error."""
    pieces = spark.read.option("lineSep", "<").text(path).where("value <> ''").select(F.col("value").alias("piece"))
    pieces = pieces.select("piece", F.substring("piece", 1, 1).isin("?", "!").alias("aside"))
    tag = lambda group: F.regexp_extract("piece", _TAG, group)
    closed = (F.col("piece").startswith("!--") & F.col("piece").contains("-->")) | (F.col("piece").startswith("!DOCTYPE") & F.col("piece").contains(">")) | F.col("piece").startswith("?")
    tags = pieces.select("piece", "aside", closed.alias("closed"), tag(1).alias("end"), tag(2).alias("name"), tag(3).alias("empty"), tag(4).alias("text"))
    step = F.when(F.col("aside") | (F.col("empty") == "/"), 0).when(F.col("end") == "/", -1).otherwise(1)
    unread = (F.col("aside") & ~F.col("closed")) | (~F.col("aside") & (F.col("name") == "") & (F.trim("piece", F.lit(" \t\r\n\ufeff")) != ""))
    faults = tags.groupBy("name").agg(F.sum(step).alias("open"), F.count_if(unread).alias("unread"), F.count(F.lit(1)).alias("n")).where("open <> 0 AND name <> '' OR unread > 0")
    bad = faults.take(1)
    if bad:
        raise ValueError(f"{path} is no whole sitemap: {bad[0].asDict()}")
    found = tags.where(~F.col("aside") & (F.col("name") == "loc") & (F.col("end") == "") & (F.col("text") != ""))
    # Entities are read by the XML parser, text by text.
    text = F.when(F.col("text").contains("&"), F.expr("xpath_string(concat('<t>', text, '</t>'), 't')")).otherwise(F.col("text"))
    return found.select(strip(text).alias("loc")).where("loc <> ''")


_ITEM = "struct<tag_name:string,tag_slug:string,tag_n:bigint,error:string>"


def _tag_item(item: Column) -> Column:
    """Tag of one list item with the failure kind, null when it is good."""
    count, name, slug = (pl.at(item, f"$.{k}") for k in ("count", "value", "slug"))
    kind = pl.kind(count)
    n = (
        F.when(kind == "BOOLEAN", F.try_variant_get(count, "$", "boolean").cast("bigint"))
        .when(kind == "STRING", strip(F.try_variant_get(count, "$", "string")).try_cast("bigint"))
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), pl.count_from_variant(count))
    )
    absent = count.isNull() | name.isNull() | slug.isNull()
    error = (
        F.when(~pl.is_object(item), pl.WRONG_TYPE)
        .when(absent, pl.MISSING)
        .when(kind.isin("VOID", "OBJECT", "ARRAY"), pl.WRONG_TYPE)
        .when(n.isNull(), pl.BAD_VALUE)
        .when((n < 0) | (pl.kind(name) != "STRING") | (pl.kind(slug) != "STRING"), "ValidationError")
    )
    return F.struct(
        F.try_variant_get(name, "$", "string").alias("tag_name"),
        F.try_variant_get(slug, "$", "string").alias("tag_slug"),
        n.alias("tag_n"), error.alias("error"),
    ).cast(_ITEM)


def _fault(kind: str | Column, part: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), F.lit(part).alias("part")).cast("struct<kind:string,part:string>")


def read_payloads(pages: DataFrame, body: str = "body", index_name: str | None = None) -> DataFrame:
    """Parsed payloads: name, count, tags, and for a bad payload the failure kind and message.

    One bad tag spoils its whole page. `pages` holds entity_slug and the JSON text.
    """
    def page(v: Column) -> Column:
        panels, links = pl.at(v, pl.PANELS_PATH), pl.at(v, pl.TAGS_PATH)
        list_error = (
            F.when(panels.isNull(), _fault(pl.MISSING, "panels"))
            .when(~pl.is_object(panels), _fault(pl.WRONG_TYPE, "panels"))
            .when(links.isNull(), _fault(pl.MISSING, "panels.taglinks"))
            .when(~pl.is_list(links), _fault(pl.WRONG_TYPE, "panels.taglinks"))
        )
        count_error = bind(pl.page_count_error(v), lambda e: F.when(e == pl.NOT_JSON, _fault(e, "body is no JSON")).when(e.isNotNull(), _fault(e, "page count")))
        index_column = F.col(index_name) if index_name else None
        return F.struct(
            pl.entity_name(v, F.col("entity_slug"), index_column).alias("name"),
            pl.page_count(v).alias("total_n"),
            F.transform(F.try_variant_get(links, "$", "array<variant>"), _tag_item).alias("tags"),
            F.coalesce(count_error, list_error).alias("error"),
        )

    read = pages.withColumn("_page", bind(F.try_parse_json(body), page))
    errors = F.filter(F.transform("_page.tags", lambda t: t.error), lambda e: e.isNotNull())
    item_error = F.get(errors, F.lit(0))
    return read.select(
        *pages.columns, F.col("_page.name").alias("payload_name"), F.col("_page.total_n").alias("total_n"),
        F.col("_page.tags").alias("tags"),
        F.coalesce(F.col("_page.error.kind"), item_error).alias("error_type"),
        F.coalesce(F.col("_page.error.part"), F.when(item_error.isNotNull(), "panels.taglinks item")).alias("error_message"),
    )


def payload_rows(parsed: DataFrame, observed_at: Column) -> DataFrame:
    """One clean-shaped row per tag of each good payload, with its place in the list."""
    good = parsed.where("error_type IS NULL").select(
        "entity_slug", "payload_name", "total_n", F.posexplode("tags").alias("tag_no", "tag"))
    return good.select(
        F.col("payload_name").alias("entity_name"), "entity_slug", "total_n",
        F.col("tag.tag_name").alias("tag_name"), F.col("tag.tag_slug").alias("tag_slug"), F.col("tag.tag_n").alias("tag_n"),
        F.lit(NORMAL_SOURCE).alias("source_type"), observed_at.alias("observed_at"), "tag_no",
    )


def payload_failures(parsed: DataFrame, url: Column, observed_at: Column) -> DataFrame:
    """One row per bad payload."""
    return parsed.where("error_type IS NOT NULL").select(
        "entity_slug", url.alias("url"), "error_type", "error_message", observed_at.alias("observed_at"))
