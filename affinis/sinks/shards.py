"""Published shards: one folder per entity, tag, set, theme or page."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affinis.functions.numbers import finite_columns
from affinis.functions.text import safe_slug
from affinis.operators.reports import count_rows, report
from affinis.session import new_path, settings
from affinis.sources.records import exists

# Layouts: a folder of JSON or parquet files for each shard, or one parquet table clustered by shard, where a
# shard is a short stretch of files. A folder each would swamp the file system with very many shards.
LAYOUTS = ("json", "parquet", "clustered")
#: Folders, and rows, that one task writes, about. A folder takes far more time than its bytes say, by which Spark would deal the rows.
FOLDERS, ROWS = 100, 50_000
#: Folders whose files the driver holds at once, some kB for each.
LISTED = 5_000
#: Rows to find the bounds of the tasks by; Spark holds the keys of three times as many in the driver, and would take 100 for each task.
SAMPLED = 50_000
_SAMPLE = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
#: While one of several groups of folders is read: a listing task for each folder, and a task for every few files, would take longer than the files;
#: and Spark would keep up to 250 MB of file names for another look at the same path.
_GROUP = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64", "spark.sql.files.openCostInBytes": "65536", "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}


def entity_order(df: DataFrame) -> list[Column]:
    """Strongest rows of an entity first."""
    lead = "z" if "z" in df.columns else "tag_n"
    return [F.col(lead).desc_nulls_last(), F.col("tag_slug").asc()]


def tag_order(df: DataFrame) -> list[Column]:
    """Rows of a tag in rank order."""
    lead = F.col("rank_within_tag_by_z").asc_nulls_last() if "rank_within_tag_by_z" in df.columns else F.col("z").desc_nulls_last()
    return [lead, F.col("entity_slug").asc()]


def leaderboard_order(df: DataFrame) -> list[Column]:
    """Order of the paged leaderboard, over all rows; the key makes it total."""
    keys = [F.col(c).desc_nulls_last() for c in ("z", "tag_n", "total_n") if c in df.columns]
    return [*keys, F.col("entity_slug").asc(), F.col("tag_slug").asc()]


def sharded(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("shard", safe_slug(key))


def write_shards(df: DataFrame, path: str, order: Sequence[Column], *, shard: str = "shard", layout: str = "json",
                 mode: str = "overwrite") -> None:
    """Write rows shard by shard, sorted inside, in the layout that is asked for.

    Rows are range-partitioned by shard and sort key together, so a shard that holds a large
    share of the rows becomes several files in order instead of one task. Where each of many shards is a folder, there are as many
    tasks as shards and rows ask for.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout {layout!r} is none of {LAYOUTS}")
    rows = finite_columns(df)
    keys = [F.col(shard).asc(), *order]
    tasks = [] if layout == "clustered" else folder_tasks(df, shard)
    placed = rows.repartitionByRange(*tasks, *keys)
    writer = placed.sortWithinPartitions(*keys).write.mode(mode)
    few = {_SAMPLE: str(max(1, min(int(df.sparkSession.conf.get(_SAMPLE, None) or 100), SAMPLED // n))) for n in tasks}
    with settings(df.sparkSession, few):
        if layout == "clustered":
            writer.parquet(path)
        elif layout == "json":
            writer.partitionBy(shard).option("ignoreNullFields", "false").json(path)
        else:
            writer.partitionBy(shard).parquet(path)


def folder_tasks(df: DataFrame, shard: str = "shard") -> list[int]:
    """The number of tasks that write rows into a folder for each shard, to be put before the keys of a repartition; none where a task can write them all, so that
    Spark deals by bytes."""
    n = df.agg(F.approx_count_distinct(shard).alias("shards"), F.count(F.lit(1)).alias("rows")).first()
    return [max(-(-n["shards"] // FOLDERS), -(-n["rows"] // ROWS))] if n["shards"] > FOLDERS else []


def read_shards(spark: SparkSession, path: str, schema: str, *, shard: str = "shard", layout: str = "json", names: Sequence[str] = ()) -> DataFrame:
    """The rows of one folder of shards, of the folders `names` in it, or of one shard if `path` ends in shard=..., with the columns of `schema`. Shard names stay text."""
    kind = "bigint" if shard == "page" else "string"
    reader = spark.read.schema(f"{schema}, {shard} {kind}" if schema else f"{shard} {kind}")
    if f"/{shard}=" in path:
        reader = reader.option("basePath", path.rsplit(f"/{shard}=", 1)[0])
    elif names:
        reader = reader.option("basePath", path)
    paths = [f"{path}/{name}" for name in names] or [path]
    return reader.json(paths) if layout == "json" else reader.parquet(*paths)


def shard_folders(spark: SparkSession, path: str, shard: str = "shard") -> list[str]:
    """Names of the folders of shards in a folder, none if it is not there. They are fetched many at a time, as a call for each name would take far longer than the listing."""
    if not exists(spark, path):
        return []
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    found = hadoop.fs.Path(path).getFileSystem(conf).listStatus(hadoop.fs.Path(path))
    names, job = [], hadoop.mapred.JobConf(False)
    for i in range(0, len(found), LISTED):
        hadoop.mapred.FileInputFormat.setInputPaths(job, hadoop.fs.FileUtil.stat2Paths(found[i:i + LISTED]))
        paths = re.split(r"(?<!\\),", job.get("mapreduce.input.fileinputformat.inputdir"))
        names += [re.sub(r"\\(.)", r"\1", p).rsplit("/", 1)[-1] for p in paths]
    return sorted(n for n in names if n.startswith(f"{shard}="))


def of_shards(spark: SparkSession, path: str, schema: str, made: Callable[[DataFrame], DataFrame], *, shard: str = "shard", layout: str = "json") -> DataFrame:
    """What `made` gives of the rows of a folder of shards, each shard by itself.

    Very many folders are read in groups, one after the other, and what is made of them is stored: the driver has to hold the places of all files of a read,
    from the plan to the end of its last action, which for a folder each would be more than it has.
    """
    names = [] if layout == "clustered" else shard_folders(spark, path, shard)
    if len(names) <= LISTED:
        return made(read_shards(spark, path, schema, shard=shard, layout=layout))
    out = new_path(spark)
    for i in range(0, len(names), LISTED):
        gc.collect()  # Java objects stay as long as Python's, which are in cycles: here the listing, and the group before
        with settings(spark, _GROUP):
            rows = made(read_shards(spark, path, schema, shard=shard, layout=layout, names=names[i:i + LISTED]))
            rows.write.mode("append").parquet(out)
    return spark.read.schema(rows.schema).parquet(out)


def stored_sizes(spark: SparkSession, path: str, family: str, *, shard: str = "shard", layout: str = "json") -> DataFrame:
    """Rows per shard as they lie in the files."""
    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col(shard).cast("string").alias("shard")).agg(count_rows().alias("row_count"))

    return of_shards(spark, path, "entity_slug string", sizes, shard=shard, layout=layout).select(F.lit(family).alias("family"), "shard", "row_count")


def file_index(spark: SparkSession, path: str, *, shard: str = "shard") -> DataFrame:
    """(shard, file, row_count) of a family in the clustered layout: the files that hold rows of each shard, so that one can be read without opening the others."""
    kind = "bigint" if shard == "page" else "string"
    stored = spark.read.schema(f"{shard} {kind}").parquet(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return stored.groupBy(F.col(shard).cast("string").alias("shard"), name.alias("file")).agg(count_rows().alias("row_count"))


def read_clustered_shard(spark: SparkSession, path: str, index: DataFrame, shard: str, column: str = "shard") -> DataFrame:
    """Rows of one shard of a family in the clustered layout, from the files that its index names; no rows and no columns' statistics of other files are read."""
    files = [r["file"] for r in index.where(F.col("shard") == shard).select("file").orderBy("file").collect()]  # the files of one shard
    if not files:
        raise KeyError(f"{path} has no shard {shard!r}")
    return spark.read.parquet(*[f"{path}/{name}" for name in files]).where(F.col(column).cast("string") == shard)


def differing_shards(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(family, shard, wanted_rows, stored_rows) of shards whose files do not hold what they should; empty when all is there."""
    both = wanted.withColumnRenamed("row_count", "wanted_rows").join(stored.withColumnRenamed("row_count", "stored_rows"), ["family", "shard"], "full")
    return both.where(~F.col("wanted_rows").eqNullSafe(F.col("stored_rows")))


def shard_sizes(df: DataFrame, key: str, families: str) -> DataFrame:
    """Rows per shard of one family."""
    return df.groupBy(safe_slug(key).alias("shard")).agg(count_rows().alias("row_count")).select(
        F.lit(families).alias("family"), "shard", "row_count")


def shard_statistics(sizes: DataFrame) -> DataFrame:
    """Shards and greatest shard of each family."""
    return sizes.groupBy("family").agg(count_rows().alias("shard_count"), F.max("row_count").alias("max_rows_in_shard"))


def missing_shards(index: DataFrame, key: str, sizes: DataFrame, family: str) -> DataFrame:
    """Entries of an index that have no shard; empty when the family is complete."""
    wanted = index.select(safe_slug(key).alias("shard")).distinct()
    there = sizes.where(F.col("family") == family).select("shard")
    return wanted.join(there, "shard", "left_anti").select(F.lit(family).alias("family"), "shard")


def shard_check(families: Sequence[tuple[str, DataFrame, str, DataFrame]]) -> DataFrame:
    """Index entries and missing shards of each family, given as (family, index, key, sizes)."""
    parts = []
    for family, index, key, sizes in families:
        missing = missing_shards(index, key, sizes, family)
        counted = report([(index.select(key).distinct(), {"index_entry_count": count_rows()}), (missing, {"missing_shard_count": count_rows()})])
        parts.append(counted.select(F.lit(family).alias("family"), "index_entry_count", "missing_shard_count"))
    return reduce(DataFrame.unionAll, parts)


def manifest(df: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """One row of figures on a published table, with the shard figures of each family in a list."""
    figures = report([
        (df, {"total_rows": count_rows()}),
        (df.select("entity_slug").distinct(), {"unique_entities": F.count("entity_slug")}),
        (df.select("tag_slug").distinct(), {"unique_tags": F.count("tag_slug")}),
    ])
    if statistics is None:
        return figures
    # One struct per shard family, a handful.
    listed = statistics.agg(F.array_sort(F.collect_list(F.struct("family", "shard_count", "max_rows_in_shard"))).alias("families"))
    both = figures.withColumn("families", F.lit(None).cast(listed.schema["families"].dataType)).unionByName(
        listed.select(*[F.lit(None).cast("bigint").alias(c) for c in figures.columns], "families"))
    return both.agg(*[F.max(c).alias(c) for c in figures.columns], F.max("families").alias("families"))
