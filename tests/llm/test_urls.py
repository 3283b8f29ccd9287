import random
import re

from affinis.llm import bloom, urls
from pyspark.sql import functions as F

LISTED = ["a.example.net/en/1", "x.com/q?page=2", None, "x.com/q?page=2"]
URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/12?x=1", "http://notexample.org/en/1", "http://x.com/fr/?a", "http://x.com/de/", "http://www.a.example.net:443/en/1/?utm_source=feed#f",
    "https://a.example.net/en/1?ref=b", "ftp://x.com/q/?page=2&utm_medium=m", "http://org", "http://org/", "a://b://c/d", "http://x.com?/fr/", "http://ex.com/\nfr/", "HTTP://É.ORG/",
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    listed = False
    if m:
        query = re.match(r"(?s).*?://[^?#]*\?([^#]*)", url)
        kept = [p for p in (query[1].split("&") if query else []) if p and not re.match(f"(?:{urls.TRACKING})(?:=|$)", p)]
        name = re.sub(r"^www\.|:(?:80|443)$", "", host) + re.sub("/+$", "", path) + ("?" + "&".join(kept) if kept else "")
        listed = name in LISTED
    return host, path, best and best.text, best.verdict if best else "block" if listed else "allow"


def test_verdicts_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "p", "l") for i, u in enumerate(URLS * 2)], "page_id long, url string, path string, listed string")
    listed = spark.createDataFrame([(u,) for u in LISTED], "canonical_url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, listed).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS * 2)}
    assert {g[3] for g in got.values() if g[2] is None} == {"allow", "block"}


def test_empty_list_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://x.net/"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "canonical_url string")
    assert [r["verdict"] for r in urls.judge(pages, none).collect()] == ["allow", "allow"]
    assert urls.judge(pages.where("false"), none).count() == 0


def test_filter_never_loses_a_key_and_passes_few_others(spark):
    rng = random.Random(6)
    keys = [str(rng.random()) for _ in range(3000)]
    sieve = bloom.build(spark.createDataFrame([(k,) for k in keys], "k string"), "k", len(keys))
    tried = spark.createDataFrame([(k, True) for k in keys] + [(str(rng.random()), False) for _ in range(20_000)] + [(None, False)], "k string, inside boolean")
    got = {r["inside"]: r for r in bloom.possible(tried, "k", sieve, "maybe").groupBy("inside").agg(F.count("*").alias("n"), F.sum(F.col("maybe").cast("int")).alias("passed")).collect()}
    assert got[True]["passed"] == 3000 and got[False]["passed"] < 200


def test_a_full_filter_changes_no_verdict(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 1)
    test_verdicts_match_brute_force(spark)
