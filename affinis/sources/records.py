"""Record files: JSON lines, JSON arrays, wrapped JSON objects, parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from affinis.operators.checks import require_columns, require_rows

# Keys under which a wrapped file may hold its records, first list wins.
WRAPPER_KEYS = ("records", "commanders", "rows", "data")
SIGNAL_WRAPPER_KEYS = ("records", "commanders")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    if not exists(spark, path):
        return []
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jvm_path)
    return [f.getPath().getName() for f in found if f.isDirectory()]


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def move(spark: SparkSession, path: str, target: str) -> None:
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"{path} could not be moved to {target}")


def sibling(path: str) -> str | None:
    return path[: -len(".jsonl")] + ".json" if path.endswith(".jsonl") else None


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, any other line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array of objects per file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_wrapped(spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str] = WRAPPER_KEYS) -> DataFrame:
    """A JSON object per file that holds its records under the first key with a list. A record that does not fit the schema fails the read."""
    kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    element = f"array<struct<{_struct_body(kind)}>>"
    whole = spark.read.text(path, wholetext=True)
    texts = [F.get_json_object("value", f"$.{key}") for key in keys]
    listed = F.coalesce(*[F.when(F.ltrim(text).startswith("["), text) for text in texts])
    checked = F.when(listed.isNull(), F.raise_error(F.lit(f"no list under {tuple(keys)}"))).otherwise(listed)
    return whole.select(F.from_json(checked, element, {"mode": "FAILFAST"}).alias("found")).select(F.inline("found"))


def _struct_body(schema: str) -> str:
    if ":" in schema.split(",")[0]:
        return schema
    return T.StructType.fromDDL(schema).simpleString().removeprefix("struct<").removesuffix(">")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, *, layout: str = "lines",
                 required: bool = True, keys: Sequence[str] = WRAPPER_KEYS) -> DataFrame:
    """Records of a file in the given layout: 'lines', 'array', 'wrapped' or 'parquet'.

    A missing `x.jsonl` is looked for as the array `x.json`. A missing optional input is an
    empty table, a missing required one an error.
    """
    if not exists(spark, path):
        other = sibling(path)
        if other and exists(spark, other):
            path, layout = other, "array"
        elif required:
            raise FileNotFoundError(f"required input is missing: {path}")
        else:
            return spark.createDataFrame([], schema)
    if layout == "parquet":
        return spark.read.parquet(path)
    if layout == "array":
        return read_array(spark, path, schema)
    if layout == "wrapped":
        return read_wrapped(spark, path, schema, keys)
    return read_lines(spark, path, schema)


def with_file_order(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """A column that orders the rows of a file read as they stand in the files.

    A split is read from its start to its end, so the file, the start of the split and the
    running number inside the task give the order without a shuffle. Apply it to the read itself.
    """
    return df.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias(name))


def read_index(spark: SparkSession, path: str, schema: T.StructType | str, layout: str = "array") -> DataFrame:
    """Entity index; every record must carry a slug."""
    df = read_records(spark, path, schema, layout=layout)
    require_columns(df, ["entity_slug"], "entity index")
    missing = F.col("entity_slug").isNull()
    slug = F.when(missing, F.raise_error(F.lit("index record without entity_slug"))).otherwise(F.col("entity_slug"))
    return df.withColumn("entity_slug", slug)


def read_facts(spark: SparkSession, path: str, schema: T.StructType | str, layout: str = "parquet") -> DataFrame:
    """Clean fact rows for analysis; an empty table is an error."""
    df = read_records(spark, path, schema, layout=layout)
    require_rows(df, path)
    return df


def read_status(spark: SparkSession, path: str, schema: T.StructType | str, layout: str = "lines") -> DataFrame:
    """Status rows; a missing file is an empty table."""
    return read_records(spark, path, schema, layout=layout, required=False)
