"""Appends that may be repeated: each batch of rows has a name and is added once, however often its writing is tried.

A batch is written to a folder of its own, over whatever an earlier try left there. A small ledger file, made when all rows are there, commits it; readers
see committed batches only, and a committed batch is never written again.

    table/batch=<name>/part-*            rows of a batch
    table/_ledger/<name>                 committed; holds the number of its rows
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from affinis.sinks.records import write_records
from affinis.sinks.versions import file_names, get_text, put_text

_LEDGER = "_ledger"


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed batches, as they stand in folder names."""
    return [name for name in file_names(spark, f"{path}/{_LEDGER}") if get_text(spark, f"{path}/{_LEDGER}/{name}")]


def committed_rows(spark: SparkSession, path: str) -> int:
    """Rows of all committed batches, from the ledger."""
    return sum(int(get_text(spark, f"{path}/{_LEDGER}/{name}")) for name in committed(spark, path))


def append_batch(df: DataFrame, path: str, batch: str, layout: str = "lines") -> int | None:
    """Add the rows as the batch of that name; its number of rows, or None if the batch is there already."""
    spark, name = df.sparkSession, quote(batch, safe="")
    if name in committed(spark, path):
        return None
    rows = write_records(df, f"{path}/batch={name}", layout=layout, figures={"rows": F.count(F.lit(1))})["rows"]
    put_text(spark, f"{path}/{_LEDGER}/{name}", str(rows), again=True)  # a ledger file cut short is no commit
    return rows


def read_batches(spark: SparkSession, path: str, schema: StructType | str, layout: str = "lines") -> DataFrame:
    """Rows of all committed batches."""
    folders = [f"{path}/batch={name}" for name in committed(spark, path)]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.parquet(*folders) if layout == "parquet" else reader.option("mode", "FAILFAST").json(folders)
