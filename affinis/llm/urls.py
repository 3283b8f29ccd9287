"""URL filters: rules for hosts and paths, and a list of canonical URLs behind a blocked Bloom filter.

The filter lets listed URLs and a few others pass; those few are settled by an exact hash join with the list. Only what passes is
shuffled. The list has one row for each URL, so a URL with very many pages can be split between tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from affinis.llm import bloom
from affinis.session import materialise


@dataclass(frozen=True)
class Rule:
    """allow or block what lies under host and path, on the host and its subdomains."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Longest rule wins. A short list: it becomes part of the plan.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: Query parameters that do not change what a page shows.
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A to Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without closing slashes, query without tracking parameters; no scheme, no fragment.
    Null and URLs without :// have none."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")), "&")
    host = F.regexp_replace(host_of(url), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, else null."""
    found = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    return F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, canonical_url, listed) for every row of `pages`.

    `listed` has a column canonical_url; repeated and null entries do no harm. Where no rule fits, listed URLs are blocked and all
    others allowed. Ids may be null or repeat; other columns are not read; empty tables give no rows.
    """
    names = materialise(listed.select(F.col("canonical_url").alias("listed_url")).where(F.col("listed_url").isNotNull()).distinct())
    sieve = bloom.build(names, "listed_url", names.count())
    sieve = bloom.Bloom(sieve.blocks, materialise(sieve.rows))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical_url"))
    rows = rows.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    marked = bloom.possible(rows, "canonical_url", sieve, "maybe")
    sure = marked.where(~F.col("maybe")).withColumn("listed", F.lit(False))
    settled = (marked.where("maybe").join(names.hint("shuffle_hash"), F.col("canonical_url") == F.col("listed_url"), "left")
               .withColumn("listed", F.col("listed_url").isNotNull()).drop("listed_url"))
    return sure.unionByName(settled).select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical_url", "listed")


def feed_targets(pages: DataFrame) -> DataFrame:
    """The list of the registered query: canonical URLs of pages that were reached by a link of a feed."""
    return pages.where(F.col("url").rlike(r"[?&]utm_source=feed(?:[&#]|$)")).select(canonical(F.col("url")).alias("canonical_url"))


_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "\n".join(
    f"SELECT page_id, {len(r.text)} AS size, '{r.text}' AS rule, '{r.verdict}' AS verdict FROM parts WHERE (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" + " UNION ALL" * (r is not RULES[-1])
    for r in RULES)
SQL = rf"""
WITH parts AS (
  SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:{TRACKING})(?:=|$)')) AS kept
  FROM pages),
named AS (
  SELECT page_id, url, host, path, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(host, '^www\.|:(?:80|443)$', '', 'g') || regexp_replace(path, '/+$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical_url
  FROM parts),
listed AS (SELECT DISTINCT canonical_url FROM named WHERE regexp_matches(url, '[?&]utm_source=feed(?:[&#]|$)')),
fits AS ({_FITS}),
best AS (SELECT page_id, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict FROM fits GROUP BY page_id)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, CASE WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       n.canonical_url, l.canonical_url IS NOT NULL AS listed
FROM named n LEFT JOIN best b USING (page_id) LEFT JOIN listed l USING (canonical_url)
"""
