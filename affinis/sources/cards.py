"""Card and print tables out of bulk card records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from affinis.sources.records import read_records

_URIS = "struct<normal:string,large:string,small:string,png:string>"


def bulk_schema(page_field: str, set_page_field: str) -> str:
    """Fields read of a bulk record; the provider names its page addresses as it likes."""
    return (f"name string, id string, color_identity array<string>, image_uris {_URIS}, card_faces array<struct<image_uris:{_URIS}>>, "
            f"set string, set_name string, released_at string, set_uri string, oracle_id string, {page_field} string, {set_page_field} string")


def card_columns(bulk: DataFrame, page_field: str, set_page_field: str) -> DataFrame:
    """Bulk records under the engine's column names; columns that are not there are empty."""
    types = {f.name: f.dataType for f in T.StructType.fromDDL(bulk_schema(page_field, set_page_field)).fields}

    def column(name: str) -> Column:
        return F.col(name) if name in bulk.columns else F.lit(None).cast(types[name])

    names = {
        "card_name": "name", "card_id": "id", "color_identity": "color_identity", "card_uri": page_field, "image_uris": "image_uris",
        "card_faces": "card_faces", "set_code": "set", "set_name": "set_name", "released_at": "released_at", "set_page_uri": set_page_field,
        "set_uri": "set_uri",
    }
    order = [F.col("ordinal")] if "ordinal" in bulk.columns else []
    return bulk.select(*[column(source).alias(name) for name, source in names.items()], *order)


def read_cards(spark: SparkSession, path: str, page_field: str, set_page_field: str, layout: str = "lines") -> DataFrame:
    """Card records of a bulk file; the same table serves as the print table."""
    bulk = read_records(spark, path, bulk_schema(page_field, set_page_field), layout=layout)
    return card_columns(bulk, page_field, set_page_field)
