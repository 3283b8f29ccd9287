"""Snapshot tables: one partition per snapshot, usually named by an ISO date."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis.config import PAIR_KEY
from affinis.operators.checks import require_columns, require_unique
from affinis.sources.records import folders


def read_snapshot(spark: SparkSession, root: str, date: str, check: bool = True) -> DataFrame:
    """Rows of one snapshot of a table partitioned by snapshot_date; other dates are not read."""
    rows = spark.read.parquet(root).where(F.col("snapshot_date").cast("string") == F.lit(date)).drop("snapshot_date")
    require_columns(rows, PAIR_KEY, root)
    if check:
        require_unique(rows, PAIR_KEY, f"{root} at {date}")
    return rows


def write_snapshot(df: DataFrame, root: str, date: str) -> None:
    """Write one snapshot, replacing the partition of that name and no other."""
    dated = df.withColumn("snapshot_date", F.lit(date))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(root)


def snapshot_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Rows per snapshot; only partition values and row counts are read."""
    dates = spark.read.parquet(root).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("row_count"))
    return dates.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def snapshot_names(spark: SparkSession, root: str) -> list[str]:
    """Names of the snapshots of a table, from its partition folders; no row is read."""
    return sorted(unquote(name.removeprefix("snapshot_date=")) for name in folders(spark, root) if name.startswith("snapshot_date="))


def snapshot_size(spark: SparkSession, root: str, date: str) -> int:
    """Rows of one snapshot; the files of other snapshots are not opened."""
    return spark.read.parquet(root).where(F.col("snapshot_date").cast("string") == F.lit(date)).count()


# A snapshot may also be stored in buckets by pair key, all snapshots of a table in as many. Two of them are joined bucket by bucket, without moving either:
#   root/<date>/buckets=<n>/part-*.parquet

def store_by_pair(df: DataFrame, root: str, date: str, buckets: int | None = None) -> None:
    """Write one snapshot in buckets by pair key, replacing the one of that name. The first snapshot of a table decides on the number of buckets."""
    spark = df.sparkSession
    known = [_buckets(spark, root, name) for name in by_pair_names(spark, root)]
    count = next(iter(known), None) or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stored_{uuid.uuid4().hex}"
    rows = df.repartition(count, *PAIR_KEY)  # one file for each bucket, by the hash that buckets go by
    rows.write.mode("overwrite").format("parquet").bucketBy(count, *PAIR_KEY).sortBy(*PAIR_KEY).option("path", f"{root}/{date}/buckets={count}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files are the table's own place


def by_pair_names(spark: SparkSession, root: str) -> list[str]:
    return sorted(name for name in folders(spark, root) if not name.startswith(("_", ".")))


def _buckets(spark: SparkSession, root: str, date: str) -> int:
    found = [int(name.removeprefix("buckets=")) for name in folders(spark, f"{root}/{date}") if name.startswith("buckets=")]
    if not found:
        raise FileNotFoundError(f"there is no snapshot {date} in {root}")
    return found[0]


def open_by_pair(spark: SparkSession, root: str, date: str) -> DataFrame:
    """Rows of one snapshot stored by store_by_pair(), known to Spark as dealt by pair key: joins, groupings and checks by that key do not shuffle it."""
    count, name = _buckets(spark, root, date), f"opened_{uuid.uuid4().hex}"
    path = f"{root}/{date}/buckets={count}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.option("basePath", path).parquet(path).schema.fields)
    keys = ", ".join(PAIR_KEY)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {count} BUCKETS LOCATION '{path}'")
    rows = spark.table(name)
    rows.schema  # resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return rows
