"""Check of ISO-8601 date and time texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from affinis.functions.text import col

_CLOCK = (
    r"(?:[01]\d|2[0-3])"
    r"(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"
)
_DATE = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?"
_ISO = f"^(?:{_DATE})(?:.{_CLOCK}(?:[+-]{_CLOCK})?)?$"


def valid_iso(c: Column | str) -> Column:
    """True where the text is an ISO date, optionally with a time and an offset.

    Calendar dates come with or without dashes, week dates with an optional day. A bare
    year or year-month is no date. One pattern tells the shape; the calendar decides the rest.
    """
    text = F.replace(col(c), F.lit("Z"), F.lit("+00:00"))

    def piece(start: int, length: int) -> Column:
        return F.substring(text, start, length)

    def week_exists(week: Column) -> Column:
        last = F.weekofyear(F.concat(piece(1, 4), F.lit("-12-28")).try_cast("date"))
        return (week.try_cast("int") >= 1) & (week.try_cast("int") <= last)

    exists = (
        F.when(piece(6, 1) == "W", week_exists(piece(7, 2)))
        .when(piece(5, 1) == "W", week_exists(piece(6, 2)))
        .when(piece(5, 1) == "-", piece(1, 10).try_cast("date").isNotNull())
        .otherwise(F.concat_ws("-", piece(1, 4), piece(5, 2), piece(7, 2)).try_cast("date").isNotNull())
    )
    full = F.coalesce(F.when(text.rlike(_ISO), exists), F.lit(False))
    # A plain day, as most texts are, needs no pattern: between its dashes and before its last digit the cast takes nothing but digits.
    bare = col(c)
    last = F.substring(bare, 10, 1)
    plain = (F.length(bare) == 10) & (F.substring(bare, 5, 1) == "-") & (F.substring(bare, 8, 1) == "-") & (last >= "0") & (last <= "9")
    return F.when(plain & bare.try_cast("date").isNotNull(), F.lit(True)).otherwise(full)
