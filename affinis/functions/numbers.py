"""Number expressions: counts, finite values, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from affinis.functions.text import bind, col, strip, strip_bare


def whole_number(stripped: Column) -> Column:
    return F.replace(stripped, F.lit(","), F.lit("")).try_cast("bigint")


def count_from_text(c: Column | str) -> Column:
    """'1,234' gives 1234; anything that is no whole number gives null."""
    return whole_number(strip(c))


def truncated(c: Column | str) -> Column:
    """Whole part of a floating number, null where it is not finite."""
    return finite(col(c).cast("double")).try_cast("bigint")


def count_from_variant(v: Column | str) -> Column:
    """Count held in a variant: whole numbers, truncated decimals, text; never a boolean."""
    def count(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return (
            F.when(kind == "BIGINT", F.try_variant_get(x, "$", "bigint"))
            .when(kind == "STRING", count_from_text(F.try_variant_get(x, "$", "string")))
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
                  truncated(F.try_variant_get(x, "$", "double")))
        )

    return bind(col(v), count)


def count_of(c: Column | str, dtype: T.DataType) -> Column:
    """Count normaliser for a column of any type a raw file may bring."""
    c = col(c)
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("bigint")
    if isinstance(dtype, T.StringType):
        return whole_number(strip_bare(c))
    if isinstance(dtype, T.VariantType):
        return count_from_variant(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return truncated(c)
    return c.cast("bigint")


def finite(c: Column | str) -> Column:
    """Null in place of NaN and the infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_number(c: Column | str) -> Column:
    """A number out of anything, null when it is blank, no number or not finite."""
    return finite(col(c).try_cast("double"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double, null where den is 0 or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def finite_columns(df):
    """The frame with NaN and infinities nulled in every floating column, nested ones included."""
    def fixed(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return finite(c)
        if isinstance(dtype, T.ArrayType) and _holds_float(dtype):
            return F.transform(c, lambda x: fixed(x, dtype.elementType))
        if isinstance(dtype, T.StructType) and _holds_float(dtype):
            inner = F.struct(*[fixed(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
            return F.when(c.isNotNull(), inner)
        if isinstance(dtype, T.MapType) and _holds_float(dtype):
            return F.transform_values(c, lambda _, v: fixed(v, dtype.valueType))
        return c

    return df.select(*[fixed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _holds_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_float(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_holds_float(f.dataType) for f in dtype.fields)
    return False
