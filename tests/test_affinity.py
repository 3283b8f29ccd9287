import pytest
from pyspark.sql import functions as F

from affinis.config import AFFINITY_COLUMNS, AffinityConfig, adopt_columns, domain_columns
from affinis.operators import affinity as af, checks

SCHEMA = ("entity_name string, entity_slug string, total_n bigint, tag_name string, tag_slug string, tag_n bigint, "
          "source_type string, observed_at string")


def fact(name, total, tag, n):
    return (f"{name.title()} One", name, total, tag.title(), tag, n, "commander_json", "2026-05-07T00:00:00+00:00")


# Three rows with an even spread, two without any, and two below a threshold each.
FACTS = [
    fact("oak", 800, "river", 120), fact("elm", 1600, "river", 400), fact("ash", 2000, "river", 700),
    fact("fir", 640, "stone", 96), fact("yew", 640, "stone", 96),
    fact("box", 90, "cloud", 27), fact("may", 900, "cloud", 3),
]


@pytest.fixture(scope="module")
def affinity(spark):
    return af.analyse(spark.createDataFrame(FACTS, SCHEMA)).cache()


def by_slug(df, tag):
    return {r["entity_slug"]: r for r in df.where(F.col("tag_slug") == tag).collect()}


def test_scores_ranks_and_percentiles(affinity):
    rows = by_slug(affinity, "river")
    assert [round(rows[s]["tag_affinity_pct"], 9) for s in ("oak", "elm", "ash")] == [0.15, 0.25, 0.35]
    assert [round(rows[s]["z"], 9) for s in ("oak", "elm", "ash")] == [-1, 0, 1]
    assert [rows[s]["rank_within_tag_by_z"] for s in ("oak", "elm", "ash")] == [3, 2, 1]
    assert [round(rows[s]["percentile_within_tag"], 9) for s in ("oak", "elm", "ash")] == [round(1 / 3, 9), round(2 / 3, 9), 1]
    assert round(rows["oak"]["tag_mean_pct"], 9) == 0.25 and round(rows["oak"]["tag_std_pct"], 9) == 0.1
    assert rows["oak"]["tag_affinity_pct_display"] == pytest.approx(15)


def test_no_spread_gives_no_z(affinity):
    rows = by_slug(affinity, "stone")
    for r in rows.values():
        assert r["tag_std_pct"] == 0 and r["z"] is None and r["rank_within_tag_by_z"] is None
        assert r["rank_within_tag_by_pct"] == 1 and r["rank_within_tag_by_tag_n"] == 1
        assert r["percentile_within_tag"] == 0.75 and not r["analysis_eligible"] and r["passes_default_filters"]


def test_small_samples_are_not_eligible(affinity):
    assert not any(r["passes_default_filters"] for r in by_slug(affinity, "cloud").values())


def test_leaderboard_summary_and_rankings(affinity):
    assert [r["entity_slug"] for r in af.global_leaderboard(affinity).collect()] == ["ash", "elm", "oak"]
    summary = {r["tag_slug"]: r for r in af.tag_summary(affinity).collect()}
    assert summary["river"]["eligible_row_count"] == 3 and summary["stone"]["max_z"] is None
    run = af.analysis_summary(affinity).first()
    assert (run["unique_entity_count"], run["unique_tag_count"], run["affinity_row_count"], run["rows_with_missing_z"]) == (7, 3, 7, 2)
    ranked = [r["tag_slug"] for r in af.tag_rankings(affinity).collect()]
    assert ranked == sorted(ranked)


def test_single_row_tag_has_no_z(spark):
    one = af.analyse(spark.createDataFrame([fact("solo", 400, "rare", 40)], SCHEMA)).first()
    assert one["z"] is None and one["tag_std_pct"] is None and one["tag_row_count"] == 1 and not one["analysis_eligible"]


def test_column_order_keeps_extras_behind(spark):
    df = af.analyse(spark.createDataFrame(FACTS, SCHEMA).withColumn("note", F.lit("x")))
    assert df.columns[:2] == ["entity_name", "entity_slug"] and df.columns[-1] == "note"


@pytest.mark.parametrize("change, rule", [
    ({"entity_name": " "}, "entity_name_blank"), ({"total_n": 0}, "total_n_not_positive"),
    ({"tag_n": -1}, "tag_n_negative"), ({"tag_n": 5000}, "tag_n_above_total_n"), ({"total_n": None}, "total_n_not_numeric"),
])
def test_bad_input_is_refused(spark, change, rule):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    row = dict(zip(names, FACTS[0])) | change
    df = spark.createDataFrame([tuple(row[n] for n in names), *FACTS[1:]], SCHEMA)
    with pytest.raises(ValueError, match=rule):
        af.analyse(df)


def test_missing_columns_and_empty_input(spark):
    df = spark.createDataFrame(FACTS, SCHEMA)
    with pytest.raises(ValueError, match="tag_n"):
        af.analyse(df.drop("tag_n"))
    with pytest.raises(ValueError, match="empty"):
        af.analyse(df.limit(0))
    assert checks.missing_columns(df.drop("z", "tag_n"), ["tag_n", "total_n"]) == ["tag_n"]


def test_standard_scores_add_up_to_nothing(spark):
    rows = [fact(f"e{i}", 500, f"t{i % 3}", (i * 37) % 400 + 1) for i in range(90)]
    got = af.analyse(spark.createDataFrame(rows, SCHEMA)).groupBy("tag_slug").agg(F.sum("z").alias("s"), F.stddev_samp("z").alias("d")).collect()
    assert all(abs(r["s"]) < 1e-9 and abs(r["d"] - 1) < 1e-9 for r in got)


def test_thresholds_can_be_set(spark):
    df = af.analyse(spark.createDataFrame(FACTS, SCHEMA), AffinityConfig(min_total_n=50, min_tag_n=1))
    assert all(r["passes_default_filters"] for r in df.collect())


def test_domain_column_names_go_both_ways(spark):
    df = spark.createDataFrame([("a", 1, 2)], "commander_slug string, total_decks_current int, tag_decks int")
    own = adopt_columns(df)
    assert own.columns == ["entity_slug", "total_n_current", "tag_n"]
    assert domain_columns(own).columns == df.columns


def test_every_published_column_goes_both_ways(spark):
    names = sorted({*AFFINITY_COLUMNS, "theme_tag_name", "theme_tag_n", "tag_name_x", "origin_set_name", "partner_card_image_urls", "tag_n_delta", "entity_slug_previous"})
    df = spark.createDataFrame([tuple(range(len(names)))], ", ".join(f"{n} int" for n in names))
    outside = domain_columns(df)
    assert "tag_name" in outside.columns and "theme_tag_decks" in outside.columns and "tag_decks_delta" in outside.columns
    assert adopt_columns(outside).columns == names
