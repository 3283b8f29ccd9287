"""Lists out of the shapes that files bring them in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from affinis.functions.text import col, strip


def list_of(c: Column | str, dtype: T.DataType) -> Column:
    """A list stays, a struct is wrapped, a '[...]' text is read as JSON (empty when broken),
    other text is split at commas, everything else gives the empty list."""
    c = col(c)
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(c, F.array().cast(dtype))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(T.ArrayType(dtype)))
    if isinstance(dtype, T.StringType):
        return list_from_text(c)
    return F.array().cast("array<string>")


def list_from_text(c: Column | str) -> Column:
    text = strip(c)
    empty = F.array().cast("array<string>")
    as_json = F.from_json(text, "array<string>")
    split = F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
    bracketed = text.startswith("[") & text.endswith("]")
    return F.coalesce(F.when(bracketed, as_json).otherwise(split), empty)


def display_list(c: Column | str, dtype: T.DataType) -> Column:
    """Non-empty items of a list column or of a comma text."""
    c = col(c)
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.filter(c, lambda x: x.isNotNull() & (x != "")), F.array().cast(dtype))
    return F.coalesce(
        F.filter(F.transform(F.split(strip(c), ","), strip), lambda x: x != ""),
        F.array().cast("array<string>"),
    )
