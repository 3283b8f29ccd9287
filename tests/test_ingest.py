import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from affinis.functions.urls import set_code_from_uri, slug_from_url
from affinis.operators import discovery as dc, signals as sg
from affinis.plans import jobs
from affinis.sinks import batches as bt
from affinis.sources import documents as dm

HOSTS = ["pages.example", "www.pages.example"]


def now():
    return F.lit("2026-05-07T00:00:00+00:00")


def payload(count=100, links=({"count": 3, "slug": "a", "value": "A"},), **more):
    doc = {"container": {"json_dict": {"card": {"num_decks": count}}}, "panels": {"taglinks": list(links)}}
    return json.dumps(doc | more)


def parse(spark, *docs):
    pages = spark.createDataFrame([(f"e-{i}", d) for i, d in enumerate(docs)], "entity_slug string, body string")
    return dm.read_payloads(pages)


@pytest.mark.parametrize("url, slug", [
    ("https://pages.example/commanders/abc", "abc"), ("https://www.pages.example/commanders/abc/?x=1#y", "abc"),
    ("https://pages.example/commanders/abc/filter", None), ("https://pages.example/cards/abc", None),
    ("https://other.example/commanders/abc", None), ("https://pages.example:80/commanders/abc", None), ("commanders/abc", None),
    ("https://PAGES.example/commanders/abc", None),
])
def test_slug_of_an_address(spark, url, slug):
    assert spark.range(1).select(slug_from_url(F.lit(url), HOSTS, "commanders")).first()[0] == slug


def test_index_and_report(spark):
    urls = ["https://pages.example/commanders/a", "https://pages.example/commanders/a/x", "https://www.pages.example/commanders/a", "https://pages.example/top"]
    df = dc.with_slug(spark.createDataFrame(list(enumerate(urls)), "n int, url string"), "url", HOSTS, "commanders")
    rows = dc.index_rows(df, "url", now(), ["n"])
    assert [r["entity_url"] for r in dc.dedupe_index(rows).collect()] == [urls[0]]
    r = dc.index_report(df).first()
    assert (r["total_locations_found"], r["records_before_deduplication"], r["records_after_deduplication"], r["duplicate_slug_count"], r["invalid_url_count"]) == (4, 2, 1, 1, 2)
    assert dc.duplicate_slugs(rows).first()[:] == ("a", 2)
    assert {r["url"] for r in dc.invalid_urls(df, "url").collect()} == {urls[1], urls[3]}


def test_sitemaps(spark, tmp_path):
    plain = "<urlset><url><loc> https://x/1 </loc></url><url><loc> </loc></url></urlset>"
    spaced = '<m:urlset xmlns:m="http://n"><m:url><m:loc>https://x/2?a=1&amp;b=2</m:loc></m:url></m:urlset>'
    (tmp_path / "a.xml").write_text(plain)
    (tmp_path / "b.xml").write_text(spaced)
    assert sorted(r["loc"] for r in dm.read_sitemaps(spark, str(tmp_path)).collect()) == ["https://x/1", "https://x/2?a=1&b=2"]
    assert [r["loc"] for r in dm.read_large_sitemap(spark, str(tmp_path / "a.xml")).collect()] == ["https://x/1"]
    (tmp_path / "c.xml").write_text(plain[:30])
    with pytest.raises((PySparkException, Py4JJavaError)):
        dm.read_sitemaps(spark, str(tmp_path)).collect()


def test_payload_rows_and_names(spark):
    legacy = json.dumps({"num_decks_avg": "1,200", "panels": {"taglinks": [{"count": "4", "slug": "b", "value": "B"}]}, "header": {"name": " ", "title": "Titled"}})
    parsed = parse(spark, payload(), legacy, payload(name=" Named "), payload(header="Head", links=[]))
    rows = {r["entity_slug"]: r for r in dm.payload_rows(parsed, now()).collect()}
    assert (rows["e-0"]["entity_name"], rows["e-0"]["total_n"], rows["e-0"]["tag_n"]) == ("E 0", 100, 3)
    assert (rows["e-1"]["entity_name"], rows["e-1"]["total_n"], rows["e-1"]["tag_n"]) == ("Titled", 1200, 4)
    assert rows["e-2"]["entity_name"] == "Named" and "e-3" not in rows
    assert parsed.where("error_type is not null").count() == 0


@pytest.mark.parametrize("doc, kind", [
    ("{", "JSONDecodeError"), ("[]", "TypeError"), ('{"panels":{"taglinks":[]}}', "KeyError"),
    (payload("bad", num_decks_avg=5), "ValueError"), (payload(None, num_decks_avg=5), "ValueError"), (payload(True), "ValueError"), (payload(-1), "ValueError"),
    ('{"num_decks_avg": 5}', "KeyError"), ('{"num_decks_avg": 5, "panels": []}', "TypeError"), ('{"num_decks_avg": 5, "panels": {}}', "KeyError"),
    ('{"num_decks_avg": 5, "panels": {"taglinks": {}}}', "TypeError"), (payload(links=["x"]), "TypeError"),
    (payload(links=[{"count": 1, "slug": "a"}]), "KeyError"), (payload(links=[{"count": "1,0", "slug": "a", "value": "A"}]), "ValueError"),
    (payload(links=[{"count": -1, "slug": "a", "value": "A"}]), "ValidationError"),
])
def test_bad_payloads_become_failures(spark, doc, kind):
    parsed = parse(spark, payload(), doc)
    assert [(r["entity_slug"], r["error_type"]) for r in dm.payload_failures(parsed, F.lit("u"), now()).collect()] == [("e-1", kind)]
    assert {r["entity_slug"] for r in dm.payload_rows(parsed, now()).collect()} == {"e-0"}


def test_zero_tag_rows_stop_the_run(spark):
    index = spark.createDataFrame([("e-0",)], "entity_slug string")
    with pytest.raises(RuntimeError):
        dc.require_tag_rows(dc.ingest_summary(index, dc.done_slugs(index.limit(0)), parse(spark, "{")))
    dc.require_tag_rows(dc.ingest_summary(index, dc.done_slugs(index.limit(0)), parse(spark, payload())))


def test_signal_outcomes(spark):
    count = lambda n: json.dumps({"container": {"json_dict": {"card": {"num_decks": n}}}})
    cases = {
        "ok": (200, None, count(7)), "zero": (200, None, count(0)), "above": (200, None, count(101)), "lost": (404, None, None),
        "down": (500, None, None), "cut": (None, "timeout", None), "junk": (200, None, "<html>"), "nototal": (200, None, count(1)), "old": (200, None, '{"num_decks_avg": "5"}'),
    }
    again = [("ok", 500, None, None), ("ok", None, "timeout", None), ("lost", 500, None, None), ("down", 503, None, count(1)), ("cut", None, "timeout", None)]
    responses = spark.createDataFrame([(s, *v) for s, v in cases.items()] + again, "entity_slug string, http_status int, transport_error string, body string")
    index = spark.createDataFrame([(s,) for s in [*cases, " ", "stranger"]], "entity_slug string")
    normal = spark.createDataFrame([(s, f"Name {s}" if s != "old" else " ", "0" if s == "nototal" else "100", 1) for s in cases] + [("ok", "Later", "5", 2)],
                                   "entity_slug string, entity_name string, total_n string, row int")
    outcome = sg.classify_responses(index, sg.normal_metadata(normal, ["row"]), responses, now())
    assert {r["entity_slug"]: r["status_type"] for r in outcome.collect()} == {
        "ok": sg.WRITTEN, "zero": sg.NO_ROWS, "above": sg.PARSE_ERROR, "lost": sg.NO_ROUTE, "down": sg.HTTP_ERROR, "cut": sg.REQUEST_ERROR,
        "junk": sg.PARSE_ERROR, "nototal": sg.PARSE_ERROR, "old": sg.WRITTEN, "": sg.NO_SLUG, "stranger": sg.NO_METADATA}
    rows = {r["entity_slug"]: r for r in sg.signal_rows(outcome).collect()}
    assert (rows["ok"]["entity_name"], rows["ok"]["total_n"], rows["ok"]["tag_n"], rows["ok"]["tag_slug"]) == ("Name ok", 100, 7, "cedh")
    assert rows["old"]["entity_name"] == "Old"
    done = dc.done_slugs(sg.signal_rows(outcome), outcome)
    assert dc.pending(index, done).collect()[0]["entity_slug"] == " "
    status = {r["entity_slug"]: r for r in sg.status_rows(outcome, F.lit("u")).collect()}
    assert status["lost"]["http_status_code"] == 404 and status["ok"]["tag_n"] == 7 and status[""]["url"] is None


def test_set_code_of_a_card_address(spark):
    got = spark.range(1).select(set_code_from_uri(F.lit("https://c.example/CARD/KHM!/1/x")), set_code_from_uri(F.lit("https://c.example/set/khm"))).first()
    assert got[:] == ("khm", None)


MAP = '<?xml version="1.0"?>\n<!-- <none> -->\n<m:urlset xmlns:m="http://maps.example/0.9">{}</m:urlset>\n'


@pytest.mark.parametrize("body, locs", [
    ("<m:url><m:loc>\n https://a.example/x?a=1&amp;b=&lt;2 </m:loc><m:loc/><m:loc> </m:loc></m:url>", ["https://a.example/x?a=1&b=<2"]),
    ("<m:url><m:loc type='t'>u</m:loc><m:location>no</m:location><m:loc\n>v > w</m:loc></m:url>", ["u", "v > w"]),
    ("", []),
])
def test_large_sitemaps_are_read_in_splits(spark, tmp_path, body, locs):
    path = tmp_path / "map.xml"
    path.write_text(MAP.replace("<!-- <none> -->", "<!-- none -->").format(body))
    assert sorted(r["loc"] for r in dm.read_large_sitemap(spark, str(path)).collect()) == sorted(locs)


@pytest.mark.parametrize("text", [
    MAP.format("<m:url><m:loc>cut</m:url>"), MAP.format("")[:-20], "no xml at all", MAP.replace("<!-- <none> -->", "").format("<m:loc><![CDATA[x]]></m:loc>"),
    MAP.format("<m:loc>x</m:loc>"), MAP.replace("<!-- <none> -->", "").format("<m:loc>a</m:loc><m:loc"),
])
def test_broken_large_sitemaps_are_an_error(spark, tmp_path, text):
    path = tmp_path / "map.xml"
    path.write_text(text)
    with pytest.raises(ValueError):
        dm.read_large_sitemap(spark, str(path))


def test_splits_of_a_large_sitemap_lose_nothing(spark, tmp_path):
    path = tmp_path / "map.xml"
    path.write_text("<urlset>" + "".join(f"<url><loc>https://a.example/{i}</loc></url>" for i in range(4000)) + "</urlset>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = dm.read_large_sitemap(spark, str(path))
        assert got.rdd.getNumPartitions() > 4 and sorted(int(r["loc"].rsplit("/", 1)[1]) for r in got.collect()) == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_ingest_may_be_repeated(spark, tmp_path):
    root = str(tmp_path)
    index = spark.createDataFrame([(f"e-{i}",) for i in range(4)], "entity_slug string")
    pages = spark.createDataFrame([("e-0", payload()), ("e-1", "{"), ("e-2", payload(links=[{"count": 1, "slug": "b", "value": "B"}, {"count": 2, "slug": "c", "value": "C"}]))], "entity_slug string, body string")
    run = lambda which, batch: jobs.run_ingest(index, which, root, batch, now(), F.lit("u")).first().asDict()
    first = run(pages.limit(2), "day 1/a")
    assert first == {"total_records_in_index": 4, "skipped_count": 0, "attempted_count": 2, "successful_count": 1, "failed_count": 1, "new_tag_row_count": 1}
    for _ in range(3):
        second = run(pages, "day 2")
    assert second["skipped_count"] == 2 and second["attempted_count"] == 1
    rows = bt.read_batches(spark, f"{root}/tag_rows", jobs.INGEST_SCHEMA)
    assert sorted(r["tag_slug"] for r in rows.collect()) == ["a", "b", "c"] and bt.committed_rows(spark, f"{root}/tag_rows") == 3
    assert spark.read.json(f"{root}/scrape_failures/batch=*").where("entity_slug = 'e-1'").count() == 2  # attempted in both runs
    with pytest.raises(RuntimeError):
        jobs.run_ingest(index, pages.where("entity_slug = 'e-1'"), f"{root}/other", "one", now(), F.lit("u"))


def test_uncommitted_batches_are_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "entity_slug string, n int")
    bad = rows.withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("disk is gone")).cast("int")).otherwise(1))
    with pytest.raises(Exception, match="disk is gone"):
        bt.append_batch(bad, root, "x")
    assert bt.read_batches(spark, root, rows.schema).count() == 0
    rows.write.json(f"{root}/batch=y")  # written, never committed
    (tmp_path / "t" / "_ledger").mkdir(exist_ok=True)
    (tmp_path / "t" / "_ledger" / "y").write_text("")
    assert bt.append_batch(rows, root, "x") == 2 and bt.append_batch(rows, root, "x") is None and bt.append_batch(rows, root, "y") == 2
    assert bt.read_batches(spark, root, rows.schema).count() == 4
