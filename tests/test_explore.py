import pytest
from pyspark.sql import functions as F

from affinis.operators import aliases as al, explore as ex

SCHEMA = "entity_slug string, entity_name string, tag_slug string, tag_name string, total_n bigint, tag_n bigint, z double"
ROWS = [("a-one", "Alpha-One", "tok", "Tokens", 300, 50, 1.5), ("b", "Bravo", "tok", "Tokens", 250, 4, None), ("c", None, "art", "Artifacts!", 100, 60, -2.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def slugs(df):
    return [r["entity_slug"] for r in df.collect()]


@pytest.mark.parametrize("query, want", [("alpha one", ["a-one"]), ("ALPHAONE", ["a-one"]), ("  ", ["a-one", "b", "c"]), ("artifacts", ["c"]), ("none", []), ("!?", ["a-one", "b", "c"])])
def test_text_filter(df, query, want):
    assert slugs(df.where(ex.text_matches(ex.ROW_TEXT, query))) == want


def test_bounds(df):
    assert slugs(df.where(ex.at_least("z", "-5"))) == ["a-one", "c"]
    assert slugs(df.where(ex.at_least("z", "abc") & ex.at_most("z", None))) == ["a-one", "b", "c"]
    assert slugs(df.where(ex.at_most("z", 0))) == ["c"]
    assert slugs(ex.filter_rows(df)) == ["a-one"]
    assert slugs(ex.filter_rows(df, min_total_n="", min_tag_n="", tag_query="tokens")) == ["a-one", "b"]


def test_user_sort(df, spark):
    assert slugs(ex.sort_rows(df, "z", False)) == ["c", "a-one", "b"]
    assert slugs(ex.sort_rows(df, "z", True)) == ["b", "a-one", "c"]
    assert slugs(ex.sort_rows(df, "entity_name", False)) == ["c", "a-one", "b"]
    mixed = spark.createDataFrame([("10",), ("9",), ("x",), (None,)], "v string")
    assert [r["v"] for r in ex.sort_rows(mixed, "v", False).collect()] == ["9", "10", None, "x"]
    assert slugs(ex.sort_rows(df, None)) == ["a-one", "b", "c"]


def test_search_window_and_options(df):
    assert slugs(ex.search_entities(df, " BRAVO ")) == ["b"]
    assert slugs(ex.search_entities(df, "")) == ["a-one", "b", "c"]
    assert slugs(ex.search_entities(df, "c", ["entity_name", "entity_slug"])) == ["c"]
    assert slugs(ex.window_of(ex.search_entities(df, ""), 1, 1)) == ["b"]
    assert [(r["slug"], r["name"]) for r in ex.tag_options(df, ["entity_slug"]).collect()] == [("art", "Artifacts!"), ("tok", "Tokens")]
    assert [r["name"] for r in ex.tag_options_of_summary(df.select("tag_slug").distinct()).collect()] == ["art", "tok"]
    assert ex.find_tag(df.select("tag_slug", "tag_name"), "Artifacts!").first()["tag_slug"] == "art"
    assert [r["tag_slug"] for r in ex.tag_index(df, None, ["entity_slug"]).collect()] == ["art", "tok"]


def test_best_tags_and_highlights(spark):
    rows = [("e", "E", f"t{i}", f"T{i}", 1, n, z) for i, (z, n) in enumerate([(None, 99), (1.0, 1), (1.0, 2), (-1.0, 3), (2.0, 1), (0.5, 5)])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r["tag_slug"] for r in ex.best_tags(df).orderBy("tag_rank").collect()] == ["t4", "t2", "t1", "t5", "t3"]
    top = ex.highlights(df).first()
    assert (top["strongest_tag"]["tag_slug"], top["largest_tag"]["tag_slug"]) == ("t4", "t0")
    assert [r["value"] for r in ex.top_values(df.withColumn("z", F.col("z") / 3), "z", 2, 2).collect()] == [0.67, 0.33]


def test_trend_wording(spark):
    rows = [("no_previous_snapshot", 1.0), ("new_pair", None), ("removed_pair", None), ("existing", 3.0), ("existing", -2.0), ("existing", 0.0), (None, None)]
    df = spark.createDataFrame(rows, "snapshot_status string, rank_delta double")
    shown = ex.with_trend_fields(df)
    assert [r[0] for r in shown.select(ex.trend_label("trend_status", "rank_delta")).collect()] == [
        "No previous snapshot yet", "New pair", "Removed pair", "▲ Rank +3", "▼ Rank -2", "Existing", "Trend unavailable"]


def test_substring_filter_and_display_share(spark):
    df = spark.createDataFrame([("a", "Alpha", ["W", "U"], 0.25, None), ("b", "Bravo", ["B"], None, 7.0)], "entity_slug string, entity_name string, color_identity array<string>, tag_affinity_pct double, pct double")
    df = df.withColumns({"total_n": F.lit(10), "tag_n": F.lit(5), "z": F.lit(1.0), "tag_name": F.lit("T"), "status": F.lit("existing")})
    assert slugs(ex.filter_by_substring(df, color="w,u")) == ["a"]
    assert slugs(ex.filter_by_substring(df, min_affinity_pct=10)) == ["a"]
    assert slugs(ex.filter_by_substring(df, entity_text="BRA", trend_status="existing")) == ["b"]
    assert [r[0] for r in df.select(ex.display_pct(df)).collect()] == [25.0, 7.0]


def test_column_fallbacks_and_row_aliases(spark, rows):
    df = spark.createDataFrame([(1, 2, 0.5, 3.0), (None, 4, None, None)], "total_n_current int, total_n_x int, affinity_pct_current double, z_x double")
    filled = al.fill_columns(df)
    assert [r["total_n"] for r in filled.collect()] == [1, None] and filled.first()["tag_affinity_pct_display"] == 50 and filled.first()["z"] == 3.0
    usual = rows(al.usual_rows(df.withColumns({"entity": F.lit("Name"), "entity_slug": F.lit("s"), "colour": F.lit("W,U"), "card_image_urls": F.lit("a, b,a")})))
    assert [r["total_n"] for r in usual] == [1, 4]
    assert usual[0]["entity_name"] == "Name" and usual[0]["color_identity"] == ["W", "U"]
    assert usual[0]["partner_card_image_urls"] == ["a", "b"] and usual[0]["card_image_url"] == "a"


def test_summary_card_reads_every_name(spark):
    df = spark.createDataFrame([("t", "5", None, 3, 0.5)], "tag_slug string, row_count string, tag_row_count int, eligible_row_count int, mean_pct double")
    got = ex.summary_card(df).first()
    assert (got["row_count"], got["eligible_count"], got["mean_pct"], got["max_z"]) == (5.0, 3.0, 0.5, None)


def test_roll_up(spark, rows):
    df = spark.createDataFrame([
        ("e", "E", "t1", "T1", 10, 5, 1.0, "", ["x"], 2.0, 1), ("e", "Later", "t2", "T2", 30, 9, 2.0, "pic", ["y", "z"], 5.0, 2), ("f", "", "t1", "T1", 20, 1, None, None, None, None, 3)],
        SCHEMA.replace("entity_slug string, ", "entity_slug string, ") + ", card_image_url string, card_names array<string>, rank_delta double, row int")
    got = rows(al.roll_up(df, ["row"]))
    assert [r["entity_slug"] for r in got] == ["e", "f"]
    assert (got[0]["entity_name"], got[0]["total_n"], got[0]["card_image_url"], got[0]["card_names"], got[0]["best_rank_delta"]) == ("E", 30, "pic", ["y", "z"], 5.0)
    assert [t["tag_slug"] for t in got[0]["top_tags"]] == ["t2", "t1"] and got[1]["entity_name"] == "f"
