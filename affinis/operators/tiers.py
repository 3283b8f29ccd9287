"""Tiers of entities by their signal tags, alone, per set and per theme."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from affinis.config import AffinityConfig, SIGNAL_NAME, SignalTags, THEME_MIN_Z
from affinis.functions.numbers import finite_number
from affinis.functions.text import bind, empty_to_null, safe_slug, tag_match_slug
from affinis.operators.keep_first import best_per_key, ordinal
from affinis.operators.reports import count_rows

# Tiers from the top: key, rank, which signal decides, lower bound of its z-score,
# whether the bound itself belongs to the tier, wording of the reason.
TIERS = (
    ("5", 5.0, "lead", 1.05, True, "at least 1.05."),
    ("4/5", 4.5, "lead", 0.95, False, "between 0.95 and 1.05."),
    ("4", 4.0, "lead", 0.05, True, "from 0.05 through 0.95."),
    ("3", 3.0, "archetype", 1.05, True, "at least 1.05."),
    ("2/3", 2.5, "archetype", 0.95, False, "between 0.95 and 1.05."),
    ("2", 2.0, "archetype", 0.05, True, "from 0.05 through 0.95."),
    ("1/2", 1.5, "archetype", 0.0, False, "positive but below 0.05."),
    ("1", 1.0, "archetype", None, None, "No cEDH or archetype tag reaches a higher bracket threshold."),
)
TIER_KEYS = tuple(t[0] for t in TIERS)
TIER_COLUMNS = ("bracket_key", "bracket_label", "bracket_rank", "decision_tag_name", "decision_tag_slug",
                "decision_z", "decision_tag_n", "bracket_reason")
# Rules by which an entity gets into a theme.
SIGNAL_RULE, THEME_RULE = "bracket_rules_only", "theme_z_and_bracket_rules"

_SCORED = "struct<neg_z:double,pos:int,tag_name:string,tag_slug:string,tag_n:bigint>"


def _scored(tag_slug: Column, tag_name: Column, z: Column, tag_n: Column, pos: Column) -> Column:
    """A tag row as a struct whose smallest value is the greatest z-score, the earlier row on a tie."""
    return F.struct((-finite_number(z)).alias("neg_z"), pos.cast("int").alias("pos"), tag_name.alias("tag_name"),
                    tag_match_slug(tag_slug, tag_name).alias("tag_slug"), tag_n.cast("bigint").alias("tag_n")).cast(_SCORED)


def _best_in_row(rows: Column, slugs: Sequence[str]) -> Column:
    return F.array_min(F.filter(rows, lambda r: r["tag_slug"].isin(*slugs) & r["neg_z"].isNotNull()))


def _best_in_group(best: Column, place: Column) -> Column:
    return F.min_by(best, F.when(best.isNotNull(), F.struct(best["neg_z"], place)))


def tier_columns(lead: Column, archetype: Column, lead_name: str = SIGNAL_NAME) -> list[Column]:
    """Tier of an entity from its best lead row and its best archetype row, either may be null."""
    scored = {"lead": lead, "archetype": archetype}

    def case(value) -> Column:
        result = None
        for tier in TIERS[:-1]:
            z = -scored[tier[2]]["neg_z"]
            test = z >= tier[3] if tier[4] else z > tier[3]
            result = F.when(test, value(tier)) if result is None else result.when(test, value(tier))
        return result.otherwise(value(TIERS[-1]))

    def reason(tier) -> Column:
        if tier[3] is None:
            return F.lit(tier[5].replace(SIGNAL_NAME, lead_name))
        name = F.lit(lead_name) if tier[2] == "lead" else F.coalesce(archetype["tag_name"], F.lit(""))
        return F.concat(name, F.lit(" z-score is " + tier[5]))

    decision = case(lambda tier: scored[tier[2]])
    return [
        case(lambda tier: F.lit(tier[0])).alias("bracket_key"),
        case(lambda tier: F.lit("Bracket " + tier[0])).alias("bracket_label"),
        case(lambda tier: F.lit(tier[1])).alias("bracket_rank"),
        empty_to_null(decision["tag_name"]).alias("decision_tag_name"),
        decision["tag_slug"].alias("decision_tag_slug"),
        (-decision["neg_z"]).alias("decision_z"),
        decision["tag_n"].alias("decision_tag_n"),
        case(reason).alias("bracket_reason"),
    ]


def _group_id(order: Sequence[str]) -> Column:
    """Slug, else name, else a key of the row's own."""
    own = F.concat(F.lit("unknown-"), F.to_json(F.struct(*order)))
    return F.coalesce(empty_to_null("entity_slug"), empty_to_null("entity_name"), own)


def tier_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), signals: SignalTags = SignalTags()) -> DataFrame:
    """One row per entity (within `by`): the columns of its first row and its tier.

    Only partial results travel: the first row and the two best signal rows.
    """
    place = ordinal(order)
    one = F.array(_scored(F.col("tag_slug"), F.col("tag_name"), F.col("z"), F.col("tag_n"), F.lit(0)))
    rows = df.withColumn("id", _group_id(order))
    return _classified(rows, one, place, [*by, "id"], signals, {}, [c for c in df.columns if c not in by])


def _classified(rows: DataFrame, scored: Column, place: Column, key: Sequence[str], signals: SignalTags,
                extra: dict[str, Column], first_columns: Sequence[str]) -> DataFrame:
    staged = rows.withColumn("_scored", scored)
    staged = staged.withColumn("_lead", _best_in_row(F.col("_scored"), [signals.lead])).withColumn(
        "_archetype", _best_in_row(F.col("_scored"), signals.archetypes))
    grouped = staged.groupBy(*key).agg(
        F.min_by(F.struct(*first_columns), place).alias("_first"),
        _best_in_group(F.col("_lead"), place).alias("_lead"),
        _best_in_group(F.col("_archetype"), place).alias("_archetype"),
        *[c.alias(n) for n, c in extra.items()],
    )
    return grouped.select(
        *key, *[F.col("_first")[c].alias(c) for c in first_columns], *extra,
        *tier_columns(F.col("_lead"), F.col("_archetype"), signals.lead_name))


def tier_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entities per tier, every tier present."""
    counted = rows.groupBy(*by).agg(*[F.count_if(F.col("bracket_key") == k).alias(f"_{i}") for i, k in enumerate(TIER_KEYS)])
    cells = F.array(*[F.struct(F.lit(k).alias("bracket_key"), F.col(f"_{i}").alias("entity_count")) for i, k in enumerate(TIER_KEYS)])
    return counted.select(*by, F.inline(cells))


def is_signal(slug: Column, signals: SignalTags) -> Column:
    return slug.isin(*signals.all)


def theme_gate(config: AffinityConfig) -> Column:
    """Whether a row gets its entity into the theme of its tag; signal tags have no bound."""
    return is_signal(safe_slug("tag_slug"), config.signals) | F.coalesce(F.col("z") >= config.theme_min_z, F.lit(False))


def signal_tags_of(df: DataFrame, signals: SignalTags) -> DataFrame:
    """Signal rows of each entity as one list, of several rows of a tag the one of greatest z; rows without an entity are left out."""
    tag = F.struct("tag_slug", "tag_name", "z", "tag_n")
    rows = df.where(is_signal(safe_slug("tag_slug"), signals) & (F.coalesce("entity_slug", F.lit("")) != "")).select("entity_slug", "tag_slug", "tag_name", "z", "tag_n")
    listed = best_per_key(rows, ["entity_slug", "tag_slug"], F.coalesce("z", F.lit(float("-inf"))), ["tag_n", "tag_name"]).groupBy("entity_slug").agg(
        F.array_sort(F.collect_list(tag)).alias("bracket_tag_rows"))
    return listed


def theme_rows(df: DataFrame, config: AffinityConfig = AffinityConfig()) -> DataFrame:
    """One row per (theme, entity) that passes the gate, with the signal tags of the entity."""
    keep = [c for c in ("entity_name", "entity_slug", "color_identity", "total_n", "card_image_url", "partner_card_image_urls",
                        "card_uri", "partner_card_uris", "card_names") if c in df.columns]
    renamed = {"tag_name": "theme_tag_name", "tag_slug": "theme_tag_slug", "z": "theme_z", "tag_n": "theme_tag_n",
               "tag_affinity_pct": "theme_affinity_pct", "rank_within_tag_by_z": "theme_rank_within_tag_by_z"}
    theme = [F.col(old).alias(new) for old, new in renamed.items() if old in df.columns]
    passing = df.where(theme_gate(config)).select(*keep, *theme)
    best = best_per_key(passing, ["theme_tag_slug", "entity_slug"], F.coalesce("theme_z", F.lit(float("-inf"))), ["theme_tag_n", "theme_tag_name"])
    listed = best.join(signal_tags_of(df, config.signals), "entity_slug", "left")
    element = dict((f.name, f.dataType) for f in listed.schema.fields)["bracket_tag_rows"]
    return listed.withColumn("bracket_tag_rows", F.coalesce("bracket_tag_rows", F.array().cast(element)))


def theme_index(df: DataFrame, order: Sequence[str], summary: DataFrame | None = None, config: AffinityConfig = AffinityConfig()) -> DataFrame:
    """One row per tag: entities that pass the gate, the gate, and the tag's summary figures."""
    passes = F.when(theme_gate(config), F.col("entity_slug"))
    themes = df.groupBy(F.col("tag_slug").alias("_tag_slug")).agg(
        F.min_by("tag_name", ordinal(order)).alias("_tag_name"), F.countDistinct(passes).alias("qualified_entity_count"))
    slug = safe_slug("_tag_slug")
    themes = themes.withColumn("_slug", slug)
    extras = []
    if summary is not None:
        side = best_per_key(summary.where(F.coalesce("tag_slug", F.lit("")) != "").withColumn("_slug", safe_slug("tag_slug")),
                            ["_slug"], F.col("tag_slug"))
        extras = [c for c in summary.columns if c not in ("tag_slug", "tag_name")]
        themes = themes.join(side, "_slug", "left")
        names = [F.coalesce("tag_slug", "_tag_slug").alias("tag_slug"), F.coalesce("tag_name", "_tag_name").alias("tag_name")]
    else:
        names = [F.col("_tag_slug").alias("tag_slug"), F.col("_tag_name").alias("tag_name")]
    signal = is_signal(F.col("_slug"), config.signals)
    return themes.select(
        *names, *extras, "qualified_entity_count",
        F.when(~signal, F.lit(config.theme_min_z)).alias("minimum_z"),
        F.when(signal, SIGNAL_RULE).otherwise(THEME_RULE).alias("qualification_rule"),
        F.concat(F.lit("theme-brackets/shard="), F.col("_slug")).alias("file"),
    ).orderBy(F.lower(F.coalesce(empty_to_null("tag_name"), empty_to_null("tag_slug"), F.lit(""))), "tag_slug")


def theme_tier_rows(df: DataFrame, order: Sequence[str], theme: str | None = None, min_z: float = THEME_MIN_Z,
                    signals: SignalTags = SignalTags()) -> DataFrame:
    """One row per entity of a theme that passes the gate, with its tier.

    Rows are flat tag rows, theme rows with a list of signal tags, or both kinds. The theme's
    score is the best one that the row, its theme fields or its signal list give; the tier
    comes from the signal list where there is one, else from the flat row. Without `theme`
    every row belongs to the theme of its own theme fields.
    """
    has = set(df.columns)

    def column(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in has else F.lit(None).cast(kind)

    theme_slug, theme_name = column("theme_tag_slug"), column("theme_tag_name")
    wanted = tag_match_slug(F.lit(theme), F.lit(None).cast("string")) if theme is not None else tag_match_slug(theme_slug, theme_name)

    def candidate(slug: Column, name: Column, z: Column, n: Column, pct: Column, pos: int | Column) -> Column:
        score = finite_number(z)
        return F.struct(score.isNull().alias("unscored"), (-score).alias("neg_z"), F.lit(pos).cast("int").alias("pos") if isinstance(pos, int) else pos.cast("int").alias("pos"),
                        tag_match_slug(slug, name).alias("slug"), name.alias("name"), n.cast("bigint").alias("n"), pct.cast("double").alias("pct"))

    flat = candidate(column("tag_slug"), column("tag_name"), column("z", "double"), column("tag_n", "bigint"), column("tag_affinity_pct", "double"), 0)
    named = F.coalesce(empty_to_null(theme_slug), empty_to_null(theme_name)).isNotNull()
    own = F.when(named, candidate(theme_slug, theme_name, column("theme_z", "double"), column("theme_tag_n", "bigint"), column("theme_affinity_pct", "double"), 1))
    candidates = F.array(flat, own)
    scored = F.array(_scored(column("tag_slug"), column("tag_name"), column("z", "double"), column("tag_n", "bigint"), F.lit(0)))
    if "bracket_tag_rows" in has:
        nothing = F.lit(None).cast("double")
        nested = F.transform("bracket_tag_rows", lambda r, i: candidate(r["tag_slug"], r["tag_name"], r["z"], r["tag_n"], nothing, i + 2))
        candidates = F.concat(candidates, F.coalesce(nested, F.slice(candidates, 1, 0)))
        listed = F.transform("bracket_tag_rows", lambda r, i: _scored(r["tag_slug"], r["tag_name"], r["z"], r["tag_n"], i))
        scored = F.coalesce(listed, scored)
    place = ordinal(order)
    rows = df.withColumn("id", _group_id(order)).withColumn("_theme", wanted).withColumn("_all", candidates)
    mine = F.array_min(F.filter("_all", lambda c: c.isNotNull() & (c["slug"] == F.col("_theme"))))
    rows = rows.withColumn("_mine", mine).drop("_all")
    best = F.min_by("_mine", F.when(F.col("_mine").isNotNull(), F.struct("_mine.unscored", "_mine.neg_z", place)))
    kept = [c for c in df.columns if c not in ("bracket_tag_rows", "theme_tag_name", "theme_tag_slug", "theme_z", "theme_tag_n", "theme_affinity_pct")]
    tiers = _classified(rows.where("_theme <> ''"), scored, place, ["_theme", "id"], signals, {"_best": best}, kept)
    passes = is_signal(F.col("_theme"), signals) | F.coalesce(-F.col("_best.neg_z") >= min_z, F.lit(False))
    return tiers.where(F.col("_best").isNotNull() & passes).select(
        "id", *kept, F.coalesce(empty_to_null("_best.name"), F.col("_theme")).alias("theme_tag_name"), F.col("_theme").alias("theme_tag_slug"),
        (-F.col("_best.neg_z")).alias("theme_z"), F.col("_best.n").alias("theme_tag_n"), F.col("_best.pct").alias("theme_affinity_pct"),
        *TIER_COLUMNS)
