"""Session helpers: local sessions for tests and bench, and cutting lineage on shared storage."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(app: str = "affinis", cores: str | int = 8, partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own. A small file comes in as many pieces as there are cores."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.files.minPartitionNum", str(cores))
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", shared or os.path.abspath("spark-warehouse/checkpoints"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. The cluster names it in spark.checkpoint.dir; without that setting there is none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    return named.rstrip("/")


#: Tables of the innermost open scratch() of this thread or task, else of the session.
_opened: ContextVar[list[str] | None] = ContextVar("opened", default=None)
_of_session: list[tuple[SparkSession, str]] = []


#: Catalog names of the tables at some paths.
_names: dict[str, str] = {}


def removed(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if path in _names:
            spark.sql(f"DROP TABLE IF EXISTS {_names.pop(path)}")
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored by materialise() or at new_path() inside are removed at the end. Read a lazy result before that."""
    paths: list[str] = []
    token = _opened.set(paths)
    try:
        yield
    finally:
        _opened.reset(token)
        removed(spark, paths)


@atexit.register
def _close() -> None:
    """What no scratch() removed goes when the driver's Python ends, while its session is still there."""
    for spark, path in _of_session:
        try:
            removed(spark, [path])
        except Exception:  # the session has ended; nothing can be removed any more
            return


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder for a table or files that only this run needs."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    opened = _opened.get()
    if opened is None:
        _of_session.append((spark, path))
    else:
        opened.append(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Spark's settings for what is read and run inside; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, keep the rows as a table in the shared folder and go on from that table.

    Later steps that read the rows several times do not repeat the work behind them, and a
    lost executor cannot change what they see. The table brings its size to the planner.
    The shuffle files behind it are dropped as soon as it is stored, by Spark's own setting for that, which is as before afterwards.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def watched(df: DataFrame, figures: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows with named aggregates that Spark takes while an action runs over them; `get` of the second has them afterwards.

    Call it right before the action, with no shuffle in between: there Spark counts a partition once, however often a lost executor's tasks run again.
    """
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in figures.items()]), seen


def stored(df: DataFrame, figures: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """materialise() with named aggregates of the rows, taken while they are written."""
    rows, seen = watched(df, figures)
    return materialise(rows), seen.get


def bucketed(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Rows stored in buckets by a hash of `keys`, in the shared folder, as a table that Spark knows to be dealt so: a join or grouping by the keys reads it
    where it lies, and only the other side moves. As many buckets as shuffle partitions, if not said otherwise. Removed as other stored tables are."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "buckets")
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _names[path] = name = f"bucketed_{uuid.uuid4().hex}"
    # One file for each bucket: the rows are dealt by the same hash first.
    df.repartition(count, *keys).write.format("parquet").bucketBy(count, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)
