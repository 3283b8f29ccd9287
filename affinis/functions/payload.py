"""Fields of page payloads, read from a parsed variant."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from affinis.functions.numbers import count_from_variant
from affinis.functions.text import bind, blank_to_null, col, name_from_slug

# Where a payload keeps its page count, its tag list and its names.
COUNT_PATH = "$.container.json_dict.card.num_decks"
LEGACY_COUNT_PATH = "$.num_decks_avg"
PANELS_PATH = "$.panels"
TAGS_PATH = "$.panels.taglinks"
NAME_PATHS = ("$.name", "$.header.name", "$.header.title", "$.header.commander_name", "$.header")

# Names of the failure kinds, after the error classes a reader of the files knows.
MISSING, WRONG_TYPE, BAD_VALUE, NOT_JSON = "KeyError", "TypeError", "ValueError", "JSONDecodeError"


def at(v: Column | str, path: str) -> Column:
    """Part of a variant, null where the path does not exist (a JSON null stays a variant)."""
    return F.try_variant_get(col(v), path, "variant")


def kind(v: Column) -> Column:
    """Type name of a variant, cut to its first word: OBJECT, ARRAY, STRING, BIGINT, VOID ..."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v) == "ARRAY", F.lit(False))


def text_at(v: Column | str, path: str) -> Column:
    """Stripped text at the path, null when it is blank or not a text."""
    return bind(at(v, path), lambda part: F.when(
        kind(part) == "STRING", blank_to_null(F.try_variant_get(part, "$", "string"))))


def page_count(v: Column | str) -> Column:
    """Page count: the current path when it exists, the legacy field only when it does not.
    A value that is there but bad gives null; it never falls back."""
    found = F.coalesce(at(v, COUNT_PATH), at(v, LEGACY_COUNT_PATH))
    return bind(count_from_variant(found), lambda n: F.when(n >= 0, n))


def page_count_error(v: Column | str) -> Column:
    """Failure kind of the page count, null when the count is good."""
    def error(x: Column) -> Column:
        absent = at(x, COUNT_PATH).isNull() & at(x, LEGACY_COUNT_PATH).isNull()
        return (F.when(x.isNull(), NOT_JSON).when(~is_object(x), WRONG_TYPE)
                .when(absent, MISSING).when(page_count(x).isNull(), BAD_VALUE))

    return bind(col(v), error)


def entity_name(v: Column | str, slug: Column | str, index_name: Column | None = None) -> Column:
    """Name from the index, else the payload, else its header, else the slug."""
    ladder = [blank_to_null(index_name)] if index_name is not None else []
    ladder += [text_at(v, p) for p in NAME_PATHS]
    return F.coalesce(*ladder, name_from_slug(slug))
