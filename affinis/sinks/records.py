"""Record sinks: JSON lines, JSON arrays, parquet tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affinis.functions.numbers import finite_columns
from affinis.operators.enrich import merge_metadata
from affinis.session import watched
from affinis.sinks.versions import read_table, replace_table
from affinis.sources.records import exists, folders, move, remove

# Tables of the publish set.
REQUIRED_TABLES = ("analysis_summary", "trend_summary", "tag_summary", "global_leaderboard", "tag_rankings", "affinity_rows_with_trends")
OPTIONAL_TABLES = ("entity_card_metadata", "trend_rows", "affinity_rows")

MANIFEST = "site_data_manifest"
SUMMARY_TABLES = ("analysis_summary", "trend_summary", "tag_summary")


def write_records(df: DataFrame, path: str, *, layout: str = "lines", mode: str = "overwrite", strict: bool = True,
                  figures: dict[str, Column] | None = None) -> dict[str, int]:
    """Write rows as 'lines', 'array' or 'parquet'. Missing values are written as JSON null;
    `strict` also nulls NaN and the infinities, at any depth. Gives the `figures` of the rows, taken while they are written."""
    rows = finite_columns(df) if strict else df
    seen = None
    if figures:
        rows, seen = watched(rows, figures)
    if layout == "parquet":
        rows.write.mode(mode).parquet(path)
    elif layout == "array":
        as_arrays(rows).write.mode(mode).text(path)
    else:
        rows.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get if seen else {}


def append_records(df: DataFrame, path: str, layout: str = "lines") -> None:
    write_records(df, path, layout=layout, mode="append")


def as_arrays(df: DataFrame) -> DataFrame:
    """Lines of text that make each part file one JSON array."""
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opening = "["
        for batch in batches:
            if len(batch):
                signs = pd.Series([","] * len(batch), index=batch.index)
                signs.iloc[0] = opening
                opening = ","
                yield pd.DataFrame({"value": signs + batch["value"]})
        yield pd.DataFrame({"value": ["[]" if opening == "[" else "]"]})

    return lines.mapInPandas(bracketed, "value string")


def lines_to_arrays(spark: SparkSession, source: str, target: str, schema) -> None:
    """The same records once more as JSON arrays."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(source)
    write_records(rows, target, layout="array", strict=False)


def copy_tables(spark: SparkSession, source: str, target: str, required: Sequence[str] = REQUIRED_TABLES,
                optional: Sequence[str] = OPTIONAL_TABLES, *, clean: bool = True) -> DataFrame:
    """Copy the tables of the publish set over those of the target; a missing required one is an error before anything is
    written. With `clean` other folders of the target go last, without they stay. Gives the manifest: one row per table, copied or missing.

    All copies are complete beside the old tables before the first of those is replaced, so a failed write changes nothing; a run that ends
    while tables are being replaced is finished by the next one.
    """
    missing = [t for t in required if not exists(spark, f"{source}/{t}")]
    if missing:
        raise FileNotFoundError(f"required tables are missing in {source}: {missing}")
    incoming = f"{target}/_incoming"
    remove(spark, incoming)
    rows = [(name, name in required, exists(spark, f"{source}/{name}")) for name in (*required, *optional)]
    present = [name for name, _, there in rows if there]
    for name in present:
        read_table(spark, f"{source}/{name}").write.parquet(f"{incoming}/{name}")
    manifest = spark.createDataFrame(rows, "table_name string, required boolean, copied boolean")
    manifest.write.parquet(f"{incoming}/{MANIFEST}")
    for name in (*present, MANIFEST):
        remove(spark, f"{target}/{name}")
        move(spark, f"{incoming}/{name}", f"{target}/{name}")
    remove(spark, incoming)
    if clean:
        for name in set(folders(spark, target)) - {*required, *optional, MANIFEST}:
            remove(spark, f"{target}/{name}")
    return manifest


def enrich_tables(spark: SparkSession, root: str, names: Sequence[str], metadata: DataFrame) -> dict[str, int]:
    """Put entity metadata into the named tables in place; tables that are not there are skipped. Gives the rows of each, counted while they are written.

    Each table is replaced as a whole (see sinks/versions.py): if a write fails, it has the rows that it had. Read the tables by read_table().
    """
    counts = {}
    for name in names:
        path = f"{root}/{name}"
        if exists(spark, path):
            counts[name] = replace_table(merge_metadata(read_table(spark, path), metadata), path, {"rows": F.count(F.lit(1))})["rows"]
    return counts
