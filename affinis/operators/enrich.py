"""Entity metadata out of card and print tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from affinis.functions.colors import ordered_colors
from affinis.functions.origin_sets import SET_TYPE, set_of_print, unique_by_code
from affinis.functions.text import bind, col, empty_to_null, name_candidates
from affinis.operators.keep_first import best_per_key, first_per_key, ordinal
from affinis.operators.reports import count_rows, report

# Outcomes of the name match, best first.
STRATEGIES = ("exact_full_name", "exact_split_parts", "fuzzy_full_name", "fuzzy_split_parts")
NOT_FOUND = "not_found"
# Image sizes in order of preference; sort key of a print without a date.
IMAGE_SIZES = ("normal", "large", "small", "png")
NO_DATE = "9999-99-99"
# Metadata columns that replace those of a row.
MERGED_COLUMNS = (
    "color_identity", "card_image_url", "partner_card_image_urls", "card_uri", "partner_card_uris",
    "card_names", "match_strategy", "origin_set_code", "origin_set_name", "origin_released_at",
    "set_page_uri", "set_uri", "origin_sets",
)
# Our rule for an approximate match: at most so many edits by the length of the name's match text, and no
# second card as near. EDIT_PERCENT can be another, up to MOST_PERCENT, where segments would be too short to tell names apart.
LEAST_EDITS, EDIT_PERCENT, MOST_PERCENT = 2, 15, 25
# Names of at most so many signs, all with two edits, take their candidates from edit_variants(), longer ones from segments.
SHORT_NAME = 19


def card_image(image_uris: Column | str, faces: Column | str) -> Column:
    """Image of a card; that of its first face with images when the card itself has none."""
    def pick(uris: Column) -> Column:
        return F.coalesce(*[empty_to_null(uris[size]) for size in IMAGE_SIZES])

    face = F.get(F.filter(col(faces), lambda f: f["image_uris"].isNotNull()), F.lit(0))["image_uris"]
    return F.when(col(image_uris).isNotNull(), pick(col(image_uris))).otherwise(pick(face))


def identities(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each entity once, with the name in its first row; the slug stands in for a missing name."""
    names = [c for c in ("entity_name", "entity") if c in rows.columns]
    name = F.coalesce(*[empty_to_null(c) for c in names], F.col("entity_slug"))
    named = rows.where(F.coalesce("entity_slug", F.lit("")) != "").select("entity_slug", name.alias("entity_name"), *order)
    first = named.groupBy("entity_slug").agg(F.min_by("entity_name", ordinal(order)).alias("entity_name"))
    return first.select("entity_name", "entity_slug").orderBy("entity_slug")


def match_text(c: Column | str) -> Column:
    """Letters and digits of any script in lower case, every run of other signs one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def edit_variants(text: Column | str) -> Column:
    """Hashes of the text and of all that is left of it after dropping one or two signs; none of the empty text."""
    def without(s: Column, i: Column) -> Column:
        return F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s)))

    def variants(s: Column) -> Column:
        n = F.length(s)
        one = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(without(s, i)))
        two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: bind(
            without(s, i), lambda t: F.transform(F.sequence(i, F.length(t)), lambda j: F.xxhash64(without(t, j))))))
        return F.when(n >= 2, F.array_distinct(F.concat(F.array(F.xxhash64(s)), one, two))).when(
            n == 1, F.array(F.xxhash64(s), F.xxhash64(F.lit("")))).otherwise(F.array().cast("array<bigint>"))

    return bind(col(text), variants)


def edits_allowed(length: Column, percent: int = EDIT_PERCENT) -> Column:
    """Edits that a name of so many signs may be away from its card: a share of its length, rounded down, and at least two."""
    return F.greatest(F.lit(LEAST_EDITS), F.floor(length * percent / 100).cast("int"))


def _segment_class(length: Column, percent: int) -> Column:
    """Signs of a segment of a name of `length` signs, and width of the stretches that places are told apart by. Segments are so short that one more would
    fit into the name: they can be laid around a common word."""
    edits = edits_allowed(length, percent)
    return F.struct(F.floor(length / (edits + 2)).cast("int").alias("q"), F.pow(F.lit(2), F.ceil(F.log2(edits))).cast("int").alias("w"))


def _segment_key(text: Column, place: Column, kind: Column, stretch: Column) -> Column:
    return F.xxhash64(text.substr(place + 1, kind["q"]), kind["q"], kind["w"], stretch)


def _part(text: Column, place: Column, q: Column) -> Column:
    return F.xxhash64(text.substr(place + 1, q), q)


def rarest_places(costs: Column, length: Column, q: Column, count: Column) -> Column:
    """Places of `count` stretches of `q` signs of a text of `length` signs that do not overlap and cost least together; `costs` has what a stretch from each
    place on costs. Of equally cheap ones those that come first. Time goes with length times count."""
    start = F.transform(F.sequence(F.lit(0), length), lambda _: F.struct(F.lit(0).cast("bigint").alias("cost"), F.array().cast("array<int>").alias("at")))
    far = F.struct(F.lit(1 << 60).cast("bigint").alias("cost"), F.array().cast("array<int>").alias("at"))

    def one_more(best: Column, _: Column) -> Column:
        """best[e] is for stretches within the first e signs; so is what comes out, with one stretch more."""
        def upto(done: Column, e: Column) -> Column:
            before = F.element_at(best, e - q + 1)
            use = F.when(e >= q, F.struct((before["cost"] + F.element_at(costs, e - q + 1)).alias("cost"), F.concat(before["at"], F.array(e - q)).alias("at")))
            return F.concat(done, F.array(F.least(F.element_at(done, -1), F.coalesce(use, far))))

        return F.aggregate(F.sequence(F.lit(1), length), F.array(far), upto)

    return F.element_at(F.aggregate(F.sequence(F.lit(1), count), start, one_more), -1)["at"]


def _name_segments(text: Column, places: Column, percent: int) -> Column:
    """The segments of a name at `places`, one more than its edits, each under the stretches of places where a card could have it."""
    n = F.length(text)
    edits = edits_allowed(n, percent)

    def keyed(kind: Column) -> Column:
        def of(i: Column) -> Column:
            at = F.element_at(places, i + 1)
            stretches = F.sequence(F.floor(F.greatest(at - i, F.lit(0)) / kind["w"]).cast("int"), F.floor((at + i) / kind["w"]).cast("int"))
            return F.transform(stretches, lambda b: F.struct(_segment_key(text, at, kind, b).alias("key"), i.alias("segment"), at.alias("place")))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), of))

    return bind(_segment_class(n, percent), keyed)


def _card_segments(text: Column, percent: int, short: int) -> Column:
    """Every stretch of signs of a card that could be the segment of a name, for all lengths above `short` of names that may be near it."""
    m = F.length(text)
    low = F.greatest(F.lit(short + 1), F.floor(m * 100 / (100 + percent)).cast("int") - LEAST_EDITS)
    high = F.ceil(m * 100 / (100 - percent)).cast("int") + LEAST_EDITS
    lengths = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    near = F.filter(lengths, lambda n: F.abs(m - n) <= edits_allowed(n, percent))
    kinds = F.filter(F.array_distinct(F.transform(near, lambda n: _segment_class(n, percent))), lambda kind: kind["q"].between(1, m))
    return F.flatten(F.transform(kinds, lambda kind: F.transform(F.sequence(F.lit(0), m - kind["q"]), lambda at: F.struct(
        _segment_key(text, at, kind, F.floor(at / kind["w"]).cast("int")).alias("key"), at.alias("place"), _part(text, at, kind["q"]).alias("part")))))


def rare_segments(named: DataFrame, stretches: DataFrame, percent: int) -> DataFrame:
    """`named` with `_places`: where to cut each name so that the cards have its segments as seldom as can be."""
    counts = stretches.groupBy("_part").agg(count_rows().alias("_cards"))
    q = _segment_class(F.col("_n"), percent)["q"]
    windows = named.select("_name_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - q), lambda p: F.struct(
        p.alias("place"), _part(F.col("_name"), p, q).alias("part")))).alias("_w")).select("_name_id", "_w.place", F.col("_w.part").alias("_part"))
    # A name has no more windows than signs.
    costs = windows.join(counts, "_part", "left").groupBy("_name_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("_cards", F.lit(0)).alias("n")))).alias("_costs"))
    costs = costs.select("_name_id", F.transform("_costs", lambda c: c["n"]).alias("_costs"))
    return named.join(costs, "_name_id").withColumn("_places", rarest_places(F.col("_costs"), F.col("_n"), q, F.col("_k") + 1)).drop("_costs")


def candidate_pairs(named: DataFrame, carded: DataFrame, percent: int, short: int) -> DataFrame:
    """Distinct (_name_id, _card_id) that include every name and card within the name's edits."""
    by_variant = named.where(F.col("_n") <= short).select("_name_id", F.explode(edit_variants("_name")).alias("_key")).join(
        carded.where(F.col("_m") <= short + LEAST_EDITS).select("_card_id", F.explode(edit_variants("_card")).alias("_key")), "_key")
    stretches = carded.where(F.col("_m") > 0).select("_card_id", "_m", F.explode(_card_segments(F.col("_card"), percent, short)).alias("_s")).select(
        "_card_id", "_m", F.col("_s.key").alias("_key"), F.col("_s.place").alias("_place"), F.col("_s.part").alias("_part"))
    cut = rare_segments(named.where(F.col("_n") > short), stretches, percent)
    segments = cut.select("_name_id", "_n", "_k", F.explode(_name_segments(F.col("_name"), F.col("_places"), percent)).alias("_s")).select(
        "_name_id", "_n", "_k", F.col("_s.key").alias("_key"), F.col("_s.segment").alias("_i"), F.col("_s.place").alias("_at"))
    shift, longer = F.col("_place") - F.col("_at"), F.col("_m") - F.col("_n")
    by_segment = segments.join(stretches.drop("_part"), "_key").where(
        (F.abs(longer) <= F.col("_k")) & (F.abs(shift) <= F.col("_i")) & (F.abs(shift - longer) <= F.col("_k") - F.col("_i")))
    return by_variant.select("_name_id", "_card_id").unionByName(by_segment.select("_name_id", "_card_id")).distinct()


def texts_to_match(names: DataFrame, cards: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(candidate, _name, _n, _k, _name_id) and (card_name, _card, _m, _card_id) with texts as they are compared."""
    texts = names.select("candidate", match_text("candidate").alias("_name")).distinct().withColumn("_n", F.length("_name"))
    named = texts.withColumn("_k", edits_allowed(F.col("_n"), percent)).withColumn("_name_id", F.xxhash64("candidate"))
    carded = cards.select("card_name", match_text("card_name").alias("_card")).distinct().withColumn("_m", F.length("_card")).withColumn(
        "_card_id", F.xxhash64("card_name"))
    return named, carded


def short_names(percent: int) -> int:
    """Signs up to which two edits are enough for every name."""
    return min(SHORT_NAME, (100 * (LEAST_EDITS + 1) - 1) // max(percent, 1))


def nearest_cards(names: DataFrame, cards: DataFrame, percent: int = EDIT_PERCENT) -> DataFrame:
    """The one card nearest to each name within its edits_allowed(), none when two are as near.

    Names are compared by match_text(); one without any letter or digit is near nothing.
    `percent` of a name's length may differ, 0 to MOST_PERCENT.

    Candidates come from equi joins, so only names that share something ever meet. Two texts within two edits of each
    other share a text that dropping up to two signs makes of both. A longer name is cut into one segment more than
    its k edits, wherever the cards have them least often, so that a word of very many cards brings no candidates as long as the rest of the name leaves room
    beside it. One segment is whole in each near card, and for some such segment i (from 0) there are i edits at most
    before it and k - i after it, which bounds its place from either end. Keys grow with the length, not its square.
    """
    if not 0 <= percent <= MOST_PERCENT:
        raise ValueError(f"percent {percent} is not within 0 to {MOST_PERCENT}")
    named, carded = texts_to_match(names, cards, percent)
    pairs = candidate_pairs(named, carded, percent, short_names(percent))
    # ids are hashes: two texts under one id only make further candidates, which the distance then judges
    met = pairs.join(named, "_name_id").join(carded, "_card_id")
    near = met.withColumn("_edits", F.expr("levenshtein(_name, _card, _k)")).where("_edits >= 0")
    ranked = near.groupBy("candidate", "_edits").agg(count_rows().alias("_cards"), F.min("card_name").alias("card_name"))
    best = ranked.groupBy("candidate").agg(F.min_by(F.struct("_cards", "card_name"), "_edits").alias("_best"))
    return best.where("_best._cards = 1").select("candidate", F.col("_best.card_name").alias("card_name"))


def match_names(entities: DataFrame, cards: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cards of each entity by the best rung of the ladder that finds any: exact full name,
    exact parts, nearest full name, nearest parts. One row per card found, with its place
    among the candidates; entities without a card have one row without."""
    keyed = cards.select(F.col("card_name"), F.lower("card_name").alias("_key"), *order)
    known = first_per_key(keyed, ["_key"], order).select("_key", F.col("card_name").alias("_exact"))
    candidates = entities.select("entity_slug", "entity_name", F.posexplode(name_candidates("entity_name")).alias("pos", "candidate"))
    by_entity = Window.partitionBy("entity_slug")
    exact = candidates.withColumn("_key", F.lower("candidate")).join(known, "_key", "left").withColumn(
        "_any", F.max(F.col("_exact").isNotNull()).over(by_entity))
    unmatched = exact.where(~F.col("_any")).select("candidate").distinct()
    nearest = nearest_cards(unmatched, known.select(F.col("_exact").alias("card_name")))
    laddered = exact.join(nearest.select("candidate", F.col("card_name").alias("_near")), "candidate", "left")
    full = F.col("pos") == 0
    rung = (
        F.when(F.col("_exact").isNotNull(), F.when(full, 0).otherwise(1))
        .when(~F.col("_any") & F.col("_near").isNotNull(), F.when(full, 2).otherwise(3))
    )
    rungs = laddered.withColumn("_rung", rung).withColumn("_best", F.min("_rung").over(by_entity))
    strategies = F.array(*[F.lit(s) for s in STRATEGIES])
    found = F.col("_best").isNotNull()
    return rungs.where((found & (F.col("_rung") == F.col("_best"))) | (~found & full)).select(
        "entity_name", "entity_slug", "pos",
        F.coalesce(F.get(strategies, F.col("_best")), F.lit(NOT_FOUND)).alias("match_strategy"),
        F.when(found, F.coalesce("_exact", "_near")).alias("card_name"),
    )


def earliest_prints(prints: DataFrame) -> DataFrame:
    """The earliest print of each card as its origin set; a print without a date comes last."""
    when = F.struct(F.coalesce(empty_to_null("released_at"), F.lit(NO_DATE)), F.coalesce("set_code", F.lit("")))
    return prints.groupBy("card_name").agg(F.min_by(_print_set(), when).alias("origin_set"))


def _print_set() -> Column:
    return set_of_print("set_code", "set_name", "released_at", "set_page_uri", "set_uri")


def card_metadata(matches: DataFrame, cards: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """One row per entity: match, names, ids, colours, images, addresses, origin sets.

    The number of cards of an entity is bounded by the parts of its name.
    """
    used = cards.select(
        "card_name", "card_id", "color_identity", "card_uri",
        card_image("image_uris", "card_faces").alias("_image"), _print_set().alias("_own_set"))
    if prints is not None:
        used = used.join(earliest_prints(prints), "card_name", "left").withColumn(
            "_set", F.when(F.col("origin_set").isNotNull(), F.col("origin_set")).otherwise(F.col("_own_set")))
    else:
        used = used.withColumn("_set", F.col("_own_set"))
    joined = matches.join(used, "card_name", "left")
    card = F.struct("pos", "card_name", "card_id", "color_identity", "card_uri", "_image", "_set")
    grouped = joined.groupBy("entity_slug").agg(
        F.max("entity_name").alias("entity_name"), F.max("match_strategy").alias("match_strategy"),
        F.array_sort(F.collect_list(F.when(F.col("card_name").isNotNull(), card))).alias("_cards"),
    )

    def texts(field: str) -> Column:
        return F.filter(F.transform("_cards", lambda c: c[field]), lambda x: x.isNotNull() & (x != ""))

    sets = unique_by_code(F.filter(F.transform("_cards", lambda c: c["_set"]), lambda s: s.isNotNull()))
    colors = F.flatten(F.filter(F.transform("_cards", lambda c: c["color_identity"]), lambda x: x.isNotNull()))
    listed = grouped.select(
        "entity_name", "entity_slug", (F.size("_cards") > 0).alias("match_found"), "match_strategy",
        texts("card_name").alias("card_names"), texts("card_id").alias("card_ids"),
        ordered_colors(colors).alias("color_identity"),
        texts("_image").alias("partner_card_image_urls"), texts("card_uri").alias("partner_card_uris"),
        F.coalesce(sets, F.array().cast(f"array<{SET_TYPE}>")).alias("origin_sets"),
    )
    first = F.get("origin_sets", F.lit(0))
    return listed.select(
        "entity_name", "entity_slug", "match_found", "match_strategy", "card_names", "card_ids", "color_identity",
        F.get("partner_card_image_urls", F.lit(0)).alias("card_image_url"), "partner_card_image_urls",
        F.get("partner_card_uris", F.lit(0)).alias("card_uri"), "partner_card_uris",
        first["set_code"].alias("origin_set_code"), first["set_name"].alias("origin_set_name"),
        first["released_at"].alias("origin_released_at"), first["set_page_uri"].alias("set_page_uri"),
        first["set_uri"].alias("set_uri"), "origin_sets",
    )


def merge_metadata(rows: DataFrame, metadata: DataFrame, order: Column | None = None) -> DataFrame:
    """Rows with the metadata columns of their entity; rows without metadata stay as they are.

    `metadata` is a stored table. With `order`, the metadata row with the greatest order stands for an entity that has several.
    """
    chosen = metadata.where(F.coalesce("entity_slug", F.lit("")) != "")
    if order is not None:
        chosen = best_per_key(chosen, ["entity_slug"], order)
    fields = [c for c in MERGED_COLUMNS if c in metadata.columns]
    side = chosen.select("entity_slug", F.struct(*fields).alias("_meta"))
    matched = F.col("_meta").isNotNull()
    merged = rows.join(side, "entity_slug", "left")
    kept = [F.col(c) for c in rows.columns if c not in fields]
    new = [
        (F.when(matched, F.col("_meta")[c]).otherwise(F.col(c)) if c in rows.columns else F.col("_meta")[c]).alias(c)
        for c in fields
    ]
    return merged.select(*kept, *new)


def enrichment_summary(metadata: DataFrame) -> DataFrame:
    """One row of figures on an enrichment run."""
    return report([(metadata, {
        "entity_count": count_rows(),
        "matched_count": F.count_if("match_found"),
        "unmatched_count": F.count_if(~F.col("match_found")),
        "rows_with_card_image_url": F.count_if(F.coalesce("card_image_url", F.lit("")) != ""),
        "rows_with_color_identity": F.count_if(F.size("color_identity") > 0),
        "rows_with_origin_set": F.count_if(F.coalesce("origin_set_code", F.lit("")) != ""),
    })])
