"""Tables that are replaced as a whole, so that a failed write leaves the old rows where they were.

Every replacement is written to a folder of its own beside the rows that readers see. Only when all its files are there does a small pointer file name it
the current version; creating that file is the one step that changes what is read. Older versions, and what a failed write left behind, are
dropped after that. A table that was never replaced is read as it lies.

    table/part-*.parquet                 as first written; dropped once a version is current
    table/_versions/000001-<id>/         rows of a version
    table/_versions/000001.current       names the folder of version 1
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affinis.session import watched
from affinis.sources.records import exists, remove

_FOLDER, _POINTER = "_versions", ".current"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def file_names(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return []
    system, jvm_path = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(jvm_path))


def put_text(spark: SparkSession, path: str, text: str, again: bool = False) -> None:
    """A new small file. That it is there already is an error, so of two writers of one version one fails; with `again` it is written over."""
    system, jvm_path = _file_system(spark, path)
    out = system.create(jvm_path, again)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def _numbers(names: list[str]) -> list[int]:
    return sorted(int(n[: -len(_POINTER)]) for n in names if n.endswith(_POINTER))


def current_path(spark: SparkSession, path: str) -> str:
    """Where the rows of a table lie now. A pointer whose file is cut short names no folder and does not count."""
    names = file_names(spark, f"{path}/{_FOLDER}")
    for number in reversed(_numbers(names)):
        folder = get_text(spark, f"{path}/{_FOLDER}/{number:06d}{_POINTER}")
        if folder in names:
            return f"{path}/{_FOLDER}/{folder}"
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of a table, whether it was ever replaced or not."""
    return spark.read.parquet(current_path(spark, path))


def replace_table(df: DataFrame, path: str, figures: dict[str, Column] | None = None) -> dict[str, int]:
    """Make `df` the rows of the table at `path`, which it may be made of. Gives `figures` of the rows, taken while they are written."""
    spark = df.sparkSession
    names = file_names(spark, f"{path}/{_FOLDER}")
    number = max(_numbers(names), default=0) + 1
    folder = f"{number:06d}-{uuid.uuid4().hex}"
    rows, seen = watched(df, figures or {"rows": F.count(F.lit(1))})
    rows.write.parquet(f"{path}/{_FOLDER}/{folder}")
    put_text(spark, f"{path}/{_FOLDER}/{number:06d}{_POINTER}", folder)
    tidy(spark, path)
    return seen.get


def tidy(spark: SparkSession, path: str) -> None:
    """Drop what no reader needs any more: older versions and their pointers, unfinished ones, and the rows as first written. May be repeated at any time
    when no replacement is under way."""
    now = current_path(spark, path)
    if now == path:
        for name in file_names(spark, f"{path}/{_FOLDER}"):
            remove(spark, f"{path}/{_FOLDER}/{name}")
        return
    folder = now.rsplit("/", 1)[1]
    pointer = folder.split("-")[0] + _POINTER
    for name in file_names(spark, path):
        if name != _FOLDER:
            remove(spark, f"{path}/{name}")
    for name in file_names(spark, f"{path}/{_FOLDER}"):
        if name not in (folder, pointer):
            remove(spark, f"{path}/{_FOLDER}/{name}")
