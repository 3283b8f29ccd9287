import pytest
from pyspark.sql import functions as F

from affinis.operators import explore as ex, groups as gr, tiers as ti

FLAT = "entity_slug string, entity_name string, tag_slug string, tag_name string, z double, tag_n bigint, row int"


def tier_of(spark, *tags):
    rows = [("e", "E", s, s.title() if s else s, z, 9, i) for i, (s, z) in enumerate(tags)]
    return ti.tier_rows(spark.createDataFrame(rows, FLAT), ["row"]).first()


@pytest.mark.parametrize("z, key", [(1.05, "5"), (1.01, "4/5"), (0.95, "4"), (0.05, "4"), (0.02, "1")])
def test_lead_bounds(spark, z, key):
    assert tier_of(spark, ("cedh", z))["bracket_key"] == key


@pytest.mark.parametrize("z, key", [(1.05, "3"), (0.98, "2/3"), (0.95, "2"), (0.02, "1/2"), (0.0, "1"), (None, "1")])
def test_archetype_bounds(spark, z, key):
    assert tier_of(spark, ("combo", z), ("ramp", 9.0))["bracket_key"] == key


def test_lead_goes_before_archetype(spark):
    got = tier_of(spark, ("aggro", 3.0), ("cEDH!", 0.06), ("tempo", 3.0))
    assert (got["bracket_key"], got["decision_tag_slug"], got["bracket_rank"], got["bracket_label"]) == ("4", "cedh", 4.0, "Bracket 4")
    got = tier_of(spark, ("cedh", 0.01), ("tempo", 3.0), ("aggro", 3.0))
    assert (got["bracket_key"], got["decision_tag_slug"], got["decision_z"]) == ("3", "tempo", 3.0)
    assert got["bracket_reason"] == "Tempo z-score is at least 1.05."


def test_no_signal_at_all(spark):
    got = tier_of(spark, ("ramp", 2.0))
    assert got["bracket_key"] == "1" and got["decision_tag_slug"] is None and got["decision_tag_n"] is None


def test_first_row_gives_the_other_columns(spark):
    rows = [("e", "Second", "ramp", "Ramp", 1.0, 1, 2), ("e", "First", "combo", "Combo", 2.0, 1, 1), (None, "Named", "combo", "Combo", 1.0, 1, 3), (None, None, "combo", "C", 1.0, 1, 4), (None, None, "combo", "C", 1.0, 1, 5)]
    got = {r["id"]: r for r in ti.tier_rows(spark.createDataFrame(rows, FLAT), ["row"]).collect()}
    assert got["e"]["entity_name"] == "First" and "Named" in got and len(got) == 4


def test_tier_counts_are_filled_with_zeros(spark):
    rows = spark.createDataFrame([("a", "5"), ("a", "5"), ("a", "1")], "g string, bracket_key string")
    got = {r["bracket_key"]: r["entity_count"] for r in ti.tier_counts(rows, ["g"]).collect()}
    assert got == {"5": 2, "4/5": 0, "4": 0, "3": 0, "2/3": 0, "2": 0, "1/2": 0, "1": 1}


def test_tier_filter_drops_entities_without_decision(spark):
    rows = spark.createDataFrame([("a", "A", 500, None, None, "1"), ("b", "B", 500, "Combo", 9, "3")],
                                 "entity_slug string, entity_name string, total_n int, decision_tag_name string, decision_tag_n int, bracket_key string")
    assert [r["entity_slug"] for r in ex.filter_tiers(rows).collect()] == ["b"]
    assert [r["entity_slug"] for r in ex.filter_tiers(rows, min_decks="").collect()] == ["a", "b"]
    assert ex.filter_tiers(rows, tier="5").count() == 0


THEMED = [
    ("a", "A", "mutate", "Mutate", 2.4, 50), ("b", "B", "mutate", "Mutate", 1.04, 40), ("a", "A", "combo", "Combo", 0.5, 30),
    ("b", "B", "combo", "Combo", None, 20), ("a", "A", "cedh", "cEDH", 1.2, 10),
]


@pytest.fixture(scope="module")
def themed(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(THEMED)], FLAT)


def test_theme_gate_and_nested_tags(themed, rows):
    got = {(r["theme_tag_slug"], r["entity_slug"]): r for r in rows(ti.theme_rows(themed))}
    assert set(got) == {("mutate", "a"), ("combo", "a"), ("combo", "b"), ("cedh", "a")}
    assert [t["tag_slug"] for t in got["mutate", "a"]["bracket_tag_rows"]] == ["cedh", "combo"]
    index = {r["tag_slug"]: r for r in rows(ti.theme_index(themed, ["row"]))}
    assert (index["mutate"]["qualified_entity_count"], index["mutate"]["minimum_z"], index["mutate"]["qualification_rule"]) == (1, 1.05, ti.THEME_RULE)
    assert (index["combo"]["qualified_entity_count"], index["combo"]["minimum_z"], index["combo"]["file"]) == (2, None, "theme-brackets/shard=combo")


def test_theme_index_keeps_themes_nobody_reaches(spark, rows):
    df = spark.createDataFrame([("a", "A", "rare", "Rare", 0.1, 1, 1)], FLAT)
    summary = spark.createDataFrame([("rare", "Rare Tag", 7)], "tag_slug string, tag_name string, tag_row_count int")
    got = rows(ti.theme_index(df, ["row"], summary))
    assert [(r["tag_name"], r["qualified_entity_count"], r["tag_row_count"]) for r in got] == [("Rare Tag", 0, 7)]


def test_theme_tiers_from_flat_and_nested_rows(themed, rows):
    flat = {r["id"]: r for r in rows(ti.theme_tier_rows(themed, ["row"], theme="Mutate"))}
    assert list(flat) == ["a"] and flat["a"]["bracket_key"] == "5" and flat["a"]["theme_z"] == 2.4 and flat["a"]["theme_tag_n"] == 50
    nested = {(r["theme_tag_slug"], r["id"]): r for r in rows(ti.theme_tier_rows(ti.theme_rows(themed), ["entity_slug"]))}
    assert {k: r["bracket_key"] for k, r in nested.items()} == {("mutate", "a"): "5", ("combo", "a"): "5", ("combo", "b"): "1", ("cedh", "a"): "5"}
    assert nested["combo", "b"]["theme_z"] is None
    # a signal theme finds its score in the list of signal tags as well
    combo = {r["id"]: r["theme_z"] for r in rows(ti.theme_tier_rows(ti.theme_rows(themed).where("theme_tag_slug = 'mutate'"), ["entity_slug"], theme="combo"))}
    assert combo == {"a": 0.5}


SETS = "entity_slug string, entity_name string, tag_slug string, tag_name string, z double, tag_n bigint, origin_set_code string, origin_set_name string, card_uri string"


def test_set_rows_and_index(spark, rows):
    df = spark.createDataFrame([("a", "A", "snow", "Snow", 1.0, 5, "khm", "Kaldheim", "https://c/card/cmm/1/x"), ("a", "A", "sultai", "Sultai", None, 5, "khm", "Later", None)], SETS)
    out = gr.set_rows(df, ["tag_slug"])
    assert [(r["origin_set_code"], r["tag_name"]) for r in rows(gr.in_set_order(out))] == [("cmm", "Snow"), ("khm", "Snow"), ("khm", "Sultai")]
    index = {r["set_code"]: r for r in rows(gr.set_index(out))}
    assert (index["khm"]["set_name"], index["khm"]["entity_count"], index["khm"]["row_count"]) == ("Kaldheim", 1, 2)
    assert index["cmm"]["set_name"] == "CMM" and index["cmm"]["file"] == "sets/shard=cmm"
    assert set(gr.SET_ROW_COLUMNS) <= set(out.columns)


def test_flat_columns_follow_the_first_set(spark, rows):
    df = spark.createDataFrame([("a", None, "kept", "https://c/card/NEO/1/x"), ("b", " ", "kept", None)], "entity_slug string, origin_set_code string, origin_set_name string, card_uri string")
    got = {r["entity_slug"]: r for r in rows(gr.with_origin_sets(df))}
    assert (got["a"]["origin_set_code"], got["a"]["origin_set_name"]) == ("neo", "NEO")
    assert got["b"]["origin_set_name"] == "kept" and got["b"]["origin_sets"] == []


def test_expansion_of_entity_rows(spark, rows):
    base = spark.createDataFrame([("a", "khm"), ("b", "khm")], "entity_slug string, origin_set_code string")
    details = spark.createDataFrame([("a", "snow", 1.0), ("c", "snow", 2.0)], "entity_slug string, tag_slug string, z double")
    kept = gr.expand_set_rows(base, details, "khm", ["entity_slug"], keep_unexpanded=True)
    assert sorted((r["entity_slug"], r["tag_slug"], r["origin_set_code"]) for r in rows(kept.where("tag_slug is not null"))) == [("a", "snow", "khm")]
    assert [r["entity_slug"] for r in rows(kept.where("tag_slug is null"))] == ["b"]
    only = gr.expand_set_rows(base, details, "khm", ["entity_slug"], keep_unexpanded=False)
    assert [r["entity_slug"] for r in rows(only)] == ["a"]
    assert gr.expand_set_rows(base, details.limit(0), "khm", ["entity_slug"], keep_unexpanded=False).count() == 2
    with_figures = base.withColumn("z", F.lit(1.0))
    assert gr.expand_set_rows(with_figures, details, "khm", ["entity_slug"], keep_unexpanded=True).columns == with_figures.columns
