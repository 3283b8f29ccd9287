"""Colour identities: fixed order, parsing, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from affinis.functions.text import col, strip

# Colour letters in display order and the names of their combinations.
COLOR_ORDER = "WUBRG"
COLOR_NAMES = {
    "W": "White", "U": "Blue", "B": "Black", "R": "Red", "G": "Green",
    "WU": "Azorius", "WB": "Orzhov", "WR": "Boros", "WG": "Selesnya", "UB": "Dimir",
    "UR": "Izzet", "UG": "Simic", "BR": "Rakdos", "BG": "Golgari", "RG": "Gruul",
    "WUB": "Esper", "WUR": "Jeskai", "WUG": "Bant", "WBR": "Mardu", "WBG": "Abzan",
    "WRG": "Naya", "UBR": "Grixis", "UBG": "Sultai", "URG": "Temur", "BRG": "Jund",
    "WUBR": "Four-colour, no Green", "WUBG": "Four-colour, no Red",
    "WURG": "Four-colour, no Black", "WBRG": "Four-colour, no Blue",
    "UBRG": "Four-colour, no White", "WUBRG": "Five-colour",
}


def ordered_colors(arr: Column | str) -> Column:
    """Known colour letters of a list, each once, in the fixed order."""
    letters = F.array(*[F.lit(x) for x in COLOR_ORDER])
    return F.filter(letters, lambda x: F.array_contains(F.coalesce(col(arr), F.array().cast("array<string>")), x))


def sorted_colors(arr: Column | str) -> Column:
    """Known colour letters of a list in the fixed order, repeats kept."""
    letters = F.array(*[F.lit(x) for x in COLOR_ORDER])
    return F.flatten(F.transform(letters, lambda x: F.filter(col(arr), lambda y: y == x)))


def colors_from_text(c: Column | str) -> Column:
    """Colour letters of 'W, U' or 'WU'; letters that are no colour are dropped."""
    text = F.upper(strip(c))
    items = F.when(text.contains(","), F.transform(F.split(text, ","), strip)).otherwise(F.split(text, ""))
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | text.isin("", "COLORLESS"), empty).otherwise(sorted_colors(items))


def loose_colors(c: Column | str) -> Column:
    """Colour list of an alias column: comma list, letters, or the text itself as one item."""
    text = strip(c)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("array<string>"))
        .when(text.contains(","), F.filter(F.transform(F.split(text, ","), strip), lambda x: x != ""))
        .when(text.rlike("^[WUBRG]+$"), F.filter(F.split(text, ""), lambda x: x != ""))
        .otherwise(F.array(text))
    )


def color_label(arr: Column | str) -> Column:
    """'WU (Azorius)' for a colour list, 'Colorless' for an empty one."""
    colors = sorted_colors(F.transform(col(arr), lambda x: F.upper(strip(x))))
    code = F.array_join(colors, "")
    names = F.create_map(*[F.lit(x) for pair in COLOR_NAMES.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, code), F.concat(F.size(colors).cast("string"), F.lit("-colour")))
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("Colorless")).otherwise(
        F.concat(code, F.lit(" ("), name, F.lit(")"))
    )
