import itertools
import random

import pytest

from pyspark.sql import functions as F

from affinis.functions.colors import color_label, colors_from_text, loose_colors, ordered_colors
from affinis.functions.lists import list_from_text
from affinis.functions.origin_sets import set_labels, sets_of_row
from affinis.functions.text import display_name, name_candidates, safe_slug, tag_match_slug, title_case
from affinis.operators import enrich as en

URIS = "struct<normal:string,large:string,small:string,png:string>"
CARD = (f"card_name string, card_id string, color_identity array<string>, card_uri string, image_uris {URIS}, card_faces array<struct<image_uris:{URIS}>>, "
        "set_code string, set_name string, released_at string, set_page_uri string, set_uri string, row int")


def card(row, name, colors=(), image=None, faces=None, code="own"):
    uris = (image, None, None, None) if image is not None else None
    return (name, f"id{row}", list(colors), f"https://c/{row}", uris, faces, code, None, None, None, None, row)


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
    return line[-1]


def test_nearest_cards_match_brute_force(spark):
    rnd = random.Random(11)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(150)})
    names, cards = words[:60], words[60:]
    got = {r["candidate"]: r["card_name"] for r in en.nearest_cards(
        spark.createDataFrame([(n,) for n in names], "candidate string"), spark.createDataFrame([(c,) for c in cards], "card_name string")).collect()}
    want = {}
    for n in names:
        ranked = sorted((distance(n, c), c) for c in cards if distance(n, c) <= 2)
        if ranked and (len(ranked) == 1 or ranked[0][0] < ranked[1][0]):
            want[n] = ranked[0][1]
    assert got == want and got


def changed(rnd, text, edits):
    for _ in range(edits):
        at, kind = rnd.randrange(len(text)), rnd.randrange(3)
        text = text[:at] + ("" if kind == 0 else rnd.choice("abcdeé")) + text[at + (kind < 2):]
    return text


def brute_nearest(names, cards, percent=15):
    want = {}
    for n in names:
        ranked = sorted((d, c) for c in cards if (d := distance(n, c)) <= max(2, len(n) * percent // 100))
        if ranked and (len(ranked) == 1 or ranked[0][0] < ranked[1][0]):
            want[n] = ranked[0][1]
    return want


def test_edits_grow_with_the_length_of_a_name(spark):
    rnd = random.Random(5)
    cards = sorted({"".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(15, 67))) for _ in range(150)})
    names = sorted({changed(rnd, c, rnd.randrange(2, 11)) for c in cards for _ in range(3)} | {changed(rnd, c[5:] + c[:5], 1) for c in cards[:40]})
    names_df, cards_df = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((names, "candidate"), (cards, "card_name")))
    for percent in (15, 0, 25):
        got = {r["candidate"]: r["card_name"] for r in en.nearest_cards(names_df, cards_df, percent).collect()}
        assert got == brute_nearest(names, cards, percent)
        if percent == 15:
            edits = {distance(n, c) for n, c in got.items() if 20 <= len(n) <= 60}
            assert edits >= {3, 4, 5, 6}


def test_a_common_word_brings_no_candidates(spark):
    """One word in a third of all cards: candidates of a name stay as few when the cards are many times as many."""
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    per_name = []
    for size in (3_000, 24_000):
        cards = [word(9) + (" dragon " if i % 3 == 0 else " " + word(6) + " ") + word(11) for i in range(size)]
        names = [changed(rnd, c, 3) for c in cards[: size // 10]]
        named, carded = en.texts_to_match(*(spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((names, "candidate"), (cards, "card_name"))), 15)
        pairs = en.candidate_pairs(named, carded, 15, en.short_names(15))
        found = pairs.join(named, "_name_id").join(carded, "_card_id").where("levenshtein(_name, _card, _k) >= 0").count()
        assert found >= 0.95 * len(set(names))
        per_name.append(pairs.count() / len(names))
    assert per_name[1] < 2.5 * per_name[0] and per_name[1] < 20


@pytest.mark.parametrize("seed", range(3))
def test_rarest_places(spark, seed):
    rnd = random.Random(seed)
    cases = []
    for _ in range(30):
        n, q = rnd.randint(4, 14), rnd.randint(1, 3)
        count = rnd.randint(1, n // q)
        cases.append(([rnd.randrange(4) for _ in range(n - q + 1)], n, q, count))
    df = spark.createDataFrame(cases, "costs array<bigint>, n int, q int, count int")
    for r in df.withColumn("at", en.rarest_places(F.col("costs"), F.col("n"), F.col("q"), F.col("count"))).collect():
        ways = [w for w in itertools.combinations(range(r["n"] - r["q"] + 1), r["count"]) if all(b - a >= r["q"] for a, b in zip(w, w[1:]))]
        assert tuple(r["at"]) == min((sum(r["costs"][p] for p in w), w) for w in ways)[1]


def test_long_names_of_one_sign_and_ties(spark):
    long = "".join(random.Random(6).choice("abcdefgh") for _ in range(1000))
    cards = ["x" * 30, "x" * 40, long, "y" * 20 + "a" * 9 + "b", "y" * 20 + "a" * 9 + "c"]
    names = ["x" * 34, "x" * 35, "x" * 36, long[:300] + long[440:], long[:300] + long[460:], "y" * 20 + "a" * 9 + "d"]
    got = {r["candidate"]: r["card_name"] for r in en.nearest_cards(
        spark.createDataFrame([(n,) for n in names], "candidate string"), spark.createDataFrame([(c,) for c in cards], "card_name string")).collect()}
    # 34 signs may have 5 edits, 860 may have 129, 840 may have 126
    assert got == {names[0]: cards[0], names[2]: cards[1]}
    near = {r["candidate"]: r["card_name"] for r in en.nearest_cards(
        spark.createDataFrame([(long[:300] + long[420:],)], "candidate string"), spark.createDataFrame([(c,) for c in cards], "card_name string")).collect()}
    assert list(near.values()) == [long]


def test_names_of_other_scripts_and_without_letters(spark):
    cards = spark.createDataFrame([("イヌ",), ("Ow",), ("???",), ("Ünal der Große",), ("x" * 300,)], "card_name string")
    names = spark.createDataFrame([("ネコ",), ("!!",), ("イヌX",), ("ünal der grosse",), ("",), ("x" * 299 + "y",), ("Owl",)], "candidate string")
    got = {r["candidate"]: r["card_name"] for r in en.nearest_cards(names, cards).collect()}
    assert got["イヌX"] == "イヌ" and got["ünal der grosse"] == "Ünal der Große" and got["Owl"] == "Ow" and got["x" * 299 + "y"] == "x" * 300
    assert "!!" not in got and "" not in got


def test_ladder(spark):
    cards = spark.createDataFrame([card(1, "Snow Queen"), card(2, "Iron King"), card(3, "Iron Kings"), card(4, "snow queen"), card(5, "Old Wizard")], CARD)
    names = ["SNOW QUEEN (Commander)", "Snow Queen // Iron King", "Nobody + Iron King", "Snwo Queen", "Old Wizrd // Nobody At All", "Iron Kin", "Nobody"]
    entities = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)], "entity_slug string, entity_name string")
    got = {}
    for r in en.match_names(entities, cards, ["row"]).orderBy("entity_slug", "pos").collect():
        got.setdefault((r["entity_slug"], r["match_strategy"]), []).append(r["card_name"])
    assert got == {
        ("e0", "exact_full_name"): ["Snow Queen"], ("e1", "exact_split_parts"): ["Snow Queen", "Iron King"], ("e2", "exact_split_parts"): ["Iron King"],
        ("e3", "fuzzy_full_name"): ["Snow Queen"], ("e4", "fuzzy_split_parts"): ["Old Wizard"], ("e5", "fuzzy_full_name"): ["Iron King"], ("e6", "not_found"): [None]}


def test_metadata_of_pairs_faces_and_prints(spark, rows):
    front = [(None,), ((None, "", "small-face", None),)]
    cards = spark.createDataFrame([card(1, "Ann", "GW", ""), card(2, "Bob", "UX", None, front, "khm"), card(3, "Cid", "", "pic", None, None)], CARD)
    prints = spark.createDataFrame([("Ann", "ZZZ", "Zed", None), ("Ann", "MMM", "", "2001-01-01"), ("Ann", "AAA", None, "2001-01-01")],
                                   "card_name string, set_code string, set_name string, released_at string").withColumns({"set_page_uri": F.lit("p"), "set_uri": F.lit("u")})
    entities = spark.createDataFrame([("pair", "Ann // Bob"), ("one", "Cid"), ("none", "Nobody Here")], "entity_slug string, entity_name string")
    got = {r["entity_slug"]: r for r in rows(en.card_metadata(en.match_names(entities, cards, ["row"]), cards, prints))}
    pair = got["pair"]
    assert pair["color_identity"] == ["W", "U", "G"] and pair["card_names"] == ["Ann", "Bob"]
    assert pair["card_image_url"] == "small-face" and pair["partner_card_image_urls"] == ["small-face"]
    assert [s["set_code"] for s in pair["origin_sets"]] == ["aaa", "khm"] and pair["origin_set_name"] == "AAA" and pair["set_uri"] == "u"
    assert got["one"]["card_image_url"] == "pic" and got["one"]["origin_sets"] == [] and got["one"]["origin_set_code"] is None
    assert not got["none"]["match_found"] and got["none"]["card_names"] == [] and got["none"]["match_strategy"] == "not_found"
    s = en.enrichment_summary(spark.createDataFrame([tuple(r.values()) for r in got.values()], en.card_metadata(en.match_names(entities, cards, ["row"]), cards, prints).schema)).first()
    assert (s["entity_count"], s["matched_count"], s["unmatched_count"], s["rows_with_card_image_url"], s["rows_with_origin_set"]) == (3, 2, 1, 2, 1)


def test_merge_keeps_rows_without_metadata(spark, rows):
    base = spark.createDataFrame([("a", "old", 1), ("b", "old", 2), (None, "old", 3)], "entity_slug string, card_uri string, n int")
    meta = spark.createDataFrame([("a", None, "x", 1), ("a", None, "y", 2), ("", "u", "z", 1)], "entity_slug string, card_uri string, card_image_url string, v int")
    got = {r["n"]: (r["card_uri"], r["card_image_url"]) for r in rows(en.merge_metadata(base, meta, F.col("v")))}
    assert got == {1: (None, "y"), 2: ("old", None), 3: ("old", None)}


def test_identities_take_the_first_name(spark):
    df = spark.createDataFrame([("b", "Bee", 2), ("b", "First", 1), ("a", "", 1), ("", "x", 1)], "entity_slug string, entity_name string, row int")
    assert [r[:] for r in en.identities(df, ["row"]).collect()] == [("a", "a"), ("First", "b")]


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()[:]


def test_text_expressions(spark):
    lit = F.lit
    assert one(spark, title_case(lit("o'brien x2y")), safe_slug(lit(" A__b!!c- ")), safe_slug(lit("!!")), tag_match_slug(lit(""), lit(" Mono_Red ")),
               display_name(lit(" A  b (COMMANDER) ")), name_candidates(lit("A // B + C"))) == (
        "O'Brien X2Y", "a__b-c", "unknown", "mono-red", "A b", ["A // B + C", "A", "B + C", "A // B", "C"])


def test_color_and_list_expressions(spark):
    lit = F.lit
    arr = lambda *x: F.array(*[lit(v) for v in x])
    assert one(spark, ordered_colors(arr("G", "x", "W")), colors_from_text(lit("g, w")), colors_from_text(lit("colorless")), loose_colors(lit("odd")),
               color_label(arr("g", "U")), color_label(arr()), color_label(arr("W", "W"))) == (
        ["W", "G"], ["W", "G"], [], ["odd"], "UG (Simic)", "Colorless", "WW (2-colour)")
    assert one(spark, list_from_text(lit('["a", "b"]')), list_from_text(lit("[a")), list_from_text(lit("[broken]")), list_from_text(lit(" a, ,b "))) == (["a", "b"], ["[a"], [], ["a", "b"])


def test_origin_sets_from_every_place(spark, rows):
    df = spark.createDataFrame([
        ('[{"code": "KHM!", "origin_set_name": "Snow"}, {"set_code": "khm"}, {"name": "none"}]', "cmm", "", "https://c/card/CMM/1/x", ["https://c/card/neo/2/y"]),
        (None, None, None, None, None)],
        "origin_sets string, origin_set_code string, origin_set_name string, card_uri string, partner_card_uris array<string>")
    got = rows(df.select(sets_of_row(df).alias("s"), set_labels(sets_of_row(df)).alias("l")))
    assert [(s["set_code"], s["set_name"]) for s in got[0]["s"]] == [("khm", "Snow"), ("cmm", "CMM"), ("neo", "NEO")]
    assert got[0]["l"] == "Snow, CMM, NEO" and got[1]["s"] == [] and got[1]["l"] == "Unknown set"
