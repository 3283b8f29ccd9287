"""Origin sets of an entity: one normal shape out of lists, flat columns and card addresses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from affinis.functions.lists import list_of
from affinis.functions.text import bind, col, empty_to_null, safe_slug, strip
from affinis.functions.urls import set_code_from_uri

SET_TYPE = "struct<set_code:string,set_name:string,released_at:string,set_page_uri:string,set_uri:string>"

# Names under which a list element may bring each field, first present wins.
ELEMENT_ALIASES = {
    "set_code": ("set_code", "code", "origin_set_code"),
    "set_name": ("set_name", "name", "origin_set_name"),
    "released_at": ("released_at", "origin_released_at"),
    "set_page_uri": ("set_page_uri", "card_uri"),
    "set_uri": ("set_uri",),
}
# Flat columns that hold the primary set, by field.
FLAT_COLUMNS = {
    "set_code": "origin_set_code",
    "set_name": "origin_set_name",
    "released_at": "origin_released_at",
    "set_page_uri": "set_page_uri",
    "set_uri": "set_uri",
}
_ELEMENT_JSON = T.StructType(
    [T.StructField(n, T.StringType()) for n in sorted({a for names in ELEMENT_ALIASES.values() for a in names})]
)


def origin_set(value: Callable[[str], Column | None], *, slug_code: bool = True) -> Column:
    """One origin set; null without a code, the name falls back to the upper-case code.

    `value(alias)` gives the column of an alias or None when the input has no such field.
    """
    def first(field: str) -> Column:
        found = [value(a) for a in ELEMENT_ALIASES[field]]
        present = [empty_to_null(v.cast("string")) for v in found if v is not None]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    code = bind(first("set_code"), lambda raw: F.when(
        strip(raw) != "", safe_slug(raw) if slug_code else F.lower(strip(raw))))
    return bind(code, lambda c: F.when(c.isNotNull(), F.struct(
        c.alias("set_code"),
        F.coalesce(first("set_name"), F.upper(c)).alias("set_name"),
        first("released_at").alias("released_at"),
        first("set_page_uri").alias("set_page_uri"),
        first("set_uri").alias("set_uri"),
    ))).cast(SET_TYPE)


def unique_by_code(sets: Column | str) -> Column:
    """First set of each code, order kept."""
    def keep(kept: Column, s: Column) -> Column:
        known = F.exists(kept, lambda e: e.set_code == s.set_code)
        return F.when(known, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(col(sets), F.array().cast(f"array<{SET_TYPE}>"), keep)


def sets_of_row(df: DataFrame, *, slug_code: bool = True) -> Column:
    """Origin sets of a row of `df`: its list, its flat columns, then the codes in its card
    addresses, each code once. Columns the frame lacks are taken as missing."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.array().cast(f"array<{SET_TYPE}>")]
    if "origin_sets" in fields:
        parts.append(_from_list("origin_sets", fields["origin_sets"], slug_code))
    flat = {field: F.col(name) for field, name in FLAT_COLUMNS.items() if name in fields}
    if "set_code" in flat:
        parts.append(F.array(origin_set(flat.get, slug_code=slug_code)))
    uris = []
    if "card_uri" in fields:
        uris.append(F.array(F.col("card_uri")))
    if "partner_card_uris" in fields:
        uris.append(list_of("partner_card_uris", fields["partner_card_uris"]))
    if uris:
        codes = F.transform(F.concat(*uris), set_code_from_uri)
        parts.append(F.transform(codes, lambda c: origin_set(
            lambda alias: c if alias == "set_code" else None, slug_code=slug_code)))
    return unique_by_code(F.filter(reduce(F.concat, parts), lambda s: s.isNotNull()))


def _from_list(name: str, dtype: T.DataType, slug_code: bool) -> Column:
    if isinstance(dtype, T.StringType):
        text = strip(name)
        items = F.when(text.startswith("[") & text.endswith("]"),
                       F.from_json(text, T.ArrayType(_ELEMENT_JSON)))
        element = _ELEMENT_JSON
    else:
        items = list_of(name, dtype)
        element = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
    if not isinstance(element, T.StructType):
        return F.array().cast(f"array<{SET_TYPE}>")
    has = set(element.names)
    return F.transform(
        F.coalesce(items, F.array().cast(T.ArrayType(element))),
        lambda s: origin_set(lambda alias: s[alias] if alias in has else None, slug_code=slug_code),
    )


def set_of_print(set_code: Column | str, set_name: Column | str, released_at: Column | str,
                 set_page_uri: Column | str, set_uri: Column | str) -> Column:
    """Origin set of a card print: lower-case code, name falling back to the upper-case code."""
    code = empty_to_null(set_code)
    return F.when(code.isNotNull(), F.struct(
        F.lower(code).alias("set_code"),
        F.coalesce(empty_to_null(set_name), F.upper(code)).alias("set_name"),
        col(released_at).alias("released_at"),
        col(set_page_uri).alias("set_page_uri"),
        col(set_uri).alias("set_uri"),
    )).cast(SET_TYPE)


def set_labels(sets: Column | str) -> Column:
    """Names of the sets joined with commas, 'Unknown set' when there are none."""
    names = F.transform(col(sets), lambda s: F.coalesce(s.set_name, F.upper(s.set_code)))
    return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("Unknown set"))


def belongs_to_set(sets: Column | str, code: str | Column) -> Column:
    """Whether one of the sets has the code, both compared as slugs."""
    wanted = safe_slug(F.lit(code) if isinstance(code, str) else code)
    return F.exists(col(sets), lambda s: safe_slug(s.set_code) == wanted)


def selected_set(sets: Column | str, code: str | Column) -> Column:
    """The first set with the code, null when none has it."""
    wanted = safe_slug(F.lit(code) if isinstance(code, str) else code)
    return F.get(F.filter(col(sets), lambda s: safe_slug(s.set_code) == wanted), F.lit(0))
