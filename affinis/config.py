"""Settings shared by every operator: thresholds, fixed vocabularies, column names."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Sample-size thresholds, theme gate and page size of the published tables.
MIN_TOTAL_N = 200
MIN_TAG_N = 5
THEME_MIN_Z = 1.05
PAGE_SIZE = 500

# Vocabulary of the source types and of the signal tags.
NORMAL_SOURCE = "commander_json"
SIGNAL_SOURCE = "cedh_filtered_json"
SIGNAL_SLUG = "cedh"
SIGNAL_NAME = "cEDH"
ARCHETYPE_SLUGS = ("aggro", "control", "midrange", "tempo", "combo")

# Columns of one clean (entity, tag) fact row.
CLEAN_COLUMNS = (
    "entity_name", "entity_slug", "total_n", "tag_name",
    "tag_slug", "tag_n", "source_type", "observed_at",
)
CLEAN_KEY = ("entity_slug", "tag_slug", "source_type")
PAIR_KEY = ("entity_slug", "tag_slug")
TEXT_COLUMNS = ("entity_name", "entity_slug", "tag_name", "tag_slug", "source_type", "observed_at")

# Order of the leading columns of an affinity row; extras follow.
AFFINITY_COLUMNS = (
    "entity_name", "entity_slug", "tag_name", "tag_slug", "source_type", "observed_at",
    "total_n", "tag_n", "tag_affinity_pct", "tag_affinity_pct_display",
    "tag_mean_pct", "tag_std_pct", "tag_row_count", "z",
    "rank_within_tag_by_z", "rank_within_tag_by_pct", "rank_within_tag_by_tag_n",
    "percentile_within_tag", "passes_default_filters", "analysis_eligible",
)

# Words of the domain files and the engine's names for them. A column such
# as "total_decks_current" is adopted as "total_n_current".
DOMAIN_WORDS = (
    ("commander_slug", "entity_slug"),
    ("commander_name", "entity_name"),
    ("commander_url", "entity_url"),
    ("total_decks", "total_n"),
    ("tag_decks", "tag_n"),
    ("scrape_timestamp", "observed_at"),
)


@dataclass(frozen=True)
class SignalTags:
    """The leading signal tag, which is checked first, and the archetype tags."""

    lead: str = SIGNAL_SLUG
    archetypes: tuple[str, ...] = ARCHETYPE_SLUGS
    lead_name: str = SIGNAL_NAME

    @property
    def all(self) -> tuple[str, ...]:
        return (self.lead, *self.archetypes)


@dataclass(frozen=True)
class AffinityConfig:
    """Thresholds and vocabularies of one run."""

    min_total_n: int = MIN_TOTAL_N
    min_tag_n: int = MIN_TAG_N
    theme_min_z: float = THEME_MIN_Z
    page_size: int = PAGE_SIZE
    signals: SignalTags = field(default_factory=SignalTags)


def adopt_columns(df, words=DOMAIN_WORDS):
    """Rename the columns of a domain file to the engine's vocabulary."""
    def rename(name: str) -> str:
        for domain, own in words:  # whole words between underscores
            name = re.sub(rf"(?<![^_]){re.escape(domain)}(?![^_])", own, name)
        return name

    return df.toDF(*[rename(c) for c in df.columns])


def domain_columns(df, words=DOMAIN_WORDS):
    """Rename the engine's columns back to the words of the domain files."""
    return adopt_columns(df, tuple((own, domain) for domain, own in words))
