"""Affinity inputs derived from the driver's tables, in Spark and in SQL.

pairs      supplier carries brand, counted in distinct orders
halves     customer carries brand, before and after the middle of the order dates
years      the same for each year of order dates
dirty      line items rewritten as raw rows with every kind of defect
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis.config import AffinityConfig, SignalTags
from catalog.registry import table

#: Line items, or rows made of them, in a task where they are joined and grouped by customer.
DEALT = 200_000
SIGNALS = SignalTags("brand-1", ("brand-2", "brand-3", "brand-4", "brand-5", "brand-6"), "Brand#1")
STRICT = AffinityConfig(min_total_n=450, min_tag_n=20, signals=SIGNALS)
OBSERVED = "2026-05-07T00:00:00+00:00"
MIDDLE = "1998-04-16"
HALVES = ("1995-01-01", MIDDLE)


def slug_of_brand(c):
    return F.lower(F.replace(c, F.lit("#"), F.lit("-")))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that so many rows ask for, as many as shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT))


def _pairs_of(base: DataFrame, letter: str) -> DataFrame:
    """Distinct orders per (entity, tag) and per entity, out of (ent, tag_name, ord) rows."""
    seen = base.select("ent", "tag_name", "ord").distinct()
    pair = seen.groupBy("ent", "tag_name").agg(F.count(F.lit(1)).alias("tag_n"))
    total = base.groupBy("ent").agg(F.countDistinct("ord").alias("total_n"))
    slug = F.concat(F.lit(letter), F.col("ent").cast("string"))
    return pair.join(total, ["ent"]).withColumn("entity_slug", slug).drop("ent")


def _clean_columns(df: DataFrame, label: str, *by: str) -> DataFrame:
    return df.select(
        *by,
        F.concat(F.lit(label + " "), F.col("entity_slug")).alias("entity_name"),
        "entity_slug", "total_n", "tag_name",
        slug_of_brand(F.col("tag_name")).alias("tag_slug"), "tag_n",
        F.lit("commander_json").alias("source_type"),
        F.lit(OBSERVED).alias("observed_at"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    base = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("ent"), F.col("p_brand").alias("tag_name"), F.col("l_orderkey").alias("ord"))
    return _clean_columns(_pairs_of(base, "s"), "Supplier")


PAIRS_SQL = f"""
base AS (SELECT 's' || l_suppkey AS entity_slug, p_brand AS tag_name, l_orderkey AS ord
         FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (
  SELECT 'Supplier ' || p.entity_slug AS entity_name, p.entity_slug, total_n, tag_name,
         lower(replace(tag_name, '#', '-')) AS tag_slug, tag_n,
         'commander_json' AS source_type, '{OBSERVED}' AS observed_at
  FROM (SELECT entity_slug, tag_name, count(DISTINCT ord) AS tag_n FROM base GROUP BY ALL) p
  JOIN (SELECT entity_slug, count(DISTINCT ord) AS total_n FROM base GROUP BY ALL) t USING (entity_slug))
"""


def affinity_sql(source: str = "pairs", prefix: str = "", min_total: int = 450, min_tag: int = 20) -> str:
    """CTEs that score the clean rows of `source`; the result is `<prefix>affinity`."""
    return f"""
{prefix}shares AS (SELECT *, tag_n::DOUBLE / total_n AS tag_affinity_pct FROM {source}),
{prefix}stats AS (SELECT tag_slug, avg(tag_affinity_pct) AS tag_mean_pct, stddev_samp(tag_affinity_pct) AS tag_std_pct,
                 count(*) AS tag_row_count FROM {prefix}shares GROUP BY tag_slug),
{prefix}scored AS (SELECT s.*, tag_affinity_pct * 100.0 AS tag_affinity_pct_display, tag_mean_pct, tag_std_pct, tag_row_count,
                  CASE WHEN tag_std_pct > 0 THEN (tag_affinity_pct - tag_mean_pct) / tag_std_pct END AS z
           FROM {prefix}shares s JOIN {prefix}stats USING (tag_slug)),
{prefix}affinity AS (
  SELECT *,
    CASE WHEN z IS NOT NULL THEN rank() OVER (PARTITION BY tag_slug ORDER BY z DESC NULLS LAST) END::BIGINT AS rank_within_tag_by_z,
    rank() OVER (PARTITION BY tag_slug ORDER BY tag_affinity_pct DESC)::BIGINT AS rank_within_tag_by_pct,
    rank() OVER (PARTITION BY tag_slug ORDER BY tag_n DESC)::BIGINT AS rank_within_tag_by_tag_n,
    (rank() OVER (PARTITION BY tag_slug ORDER BY tag_affinity_pct)
      + (count(*) OVER (PARTITION BY tag_slug, tag_affinity_pct) - 1) / 2.0) / tag_row_count AS percentile_within_tag,
    total_n >= {min_total} AND tag_n >= {min_tag} AS passes_default_filters,
    total_n >= {min_total} AND tag_n >= {min_tag} AND z IS NOT NULL AND tag_std_pct > 0 AND tag_row_count > 1 AS analysis_eligible
  FROM {prefix}scored)
"""


def dated_pairs(spark: SparkSession, folder: str, snapshot) -> DataFrame:
    """Clean rows per snapshot; `snapshot` maps the order date to a snapshot name."""
    line = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # Every step is dealt in as many tasks as the rows ask for, as each task also holds the groups of its rows; dealt by size, few bytes of many rows fill few tasks.
    # The side with one row per key is hashed and the other streams by, so a task sorts nothing and a key of many rows takes no memory.
    parts = tasks_for(spark, max(line.count(), orders.count()))
    if part.count() > DEALT:
        line, part = line.repartition(parts, "l_partkey"), part.repartition(parts, "p_partkey").hint("shuffle_hash")
    line = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    base = (
        line.repartition(parts, "l_orderkey")
        .join(orders.repartition(parts, "o_orderkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            snapshot(F.col("o_orderdate").cast("date").cast("string")).alias("snapshot_date"),
            F.col("o_custkey").alias("ent"),
            F.col("p_brand").alias("tag_name"), F.col("l_orderkey").alias("ord"))
    )
    by = ("snapshot_date", "ent")
    # Rows of one order lie in one task, so each order is told apart there, before the rows are dealt by customer.
    seen = base.distinct()
    pair = seen.repartition(parts, *by).groupBy(*by, "tag_name").agg(F.count(F.lit(1)).alias("tag_n"))
    total = seen.select(*by, "ord").distinct().repartition(parts, *by).groupBy(*by).agg(F.count(F.lit(1)).alias("total_n"))
    slug = F.concat(F.lit("c"), F.col("ent").cast("string"))
    both = pair.join(total.hint("shuffle_hash"), list(by)).withColumn("entity_slug", slug).drop("ent")
    return _clean_columns(both, "Customer", "snapshot_date")


def half_of(day):
    return F.when(day < MIDDLE, F.lit(HALVES[0])).otherwise(F.lit(HALVES[1]))


def year_of(day):
    return F.concat(F.substring(day, 1, 4), F.lit("-01-01"))


def halves(spark: SparkSession, folder: str) -> DataFrame:
    return dated_pairs(spark, folder, half_of)


def years(spark: SparkSession, folder: str) -> DataFrame:
    return dated_pairs(spark, folder, year_of)


def dated_sql(snapshot: str) -> str:
    return f"""
base AS (SELECT {snapshot} AS snapshot_date, 'c' || o_custkey AS entity_slug, p_brand AS tag_name, l_orderkey AS ord
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
dated AS (
  SELECT p.snapshot_date, 'Customer ' || p.entity_slug AS entity_name, p.entity_slug, total_n, tag_name,
         lower(replace(tag_name, '#', '-')) AS tag_slug, tag_n,
         'commander_json' AS source_type, '{OBSERVED}' AS observed_at
  FROM (SELECT snapshot_date, entity_slug, tag_name, count(DISTINCT ord) AS tag_n FROM base GROUP BY ALL) p
  JOIN (SELECT snapshot_date, entity_slug, count(DISTINCT ord) AS total_n FROM base GROUP BY ALL) t USING (snapshot_date, entity_slug))
"""


HALVES_SQL = dated_sql(f"CASE WHEN strftime(o_orderdate, '%Y-%m-%d') < '{MIDDLE}' THEN '{HALVES[0]}' ELSE '{HALVES[1]}' END") + f""",
prev_rows AS (SELECT * EXCLUDE snapshot_date FROM dated WHERE snapshot_date = '{HALVES[0]}'),
cur_rows AS (SELECT * EXCLUDE snapshot_date FROM dated WHERE snapshot_date = '{HALVES[1]}'),
""" + affinity_sql("prev_rows", "p_") + "," + affinity_sql("cur_rows", "c_")
YEARS_SQL = dated_sql("strftime(o_orderdate, '%Y-01-01')")


# Raw rows with defects: blank and padded slugs, texts and impossible values for counts,
# unknown sources, dates that are none. The four ordinal columns together are unique.
DIRTY_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    key, supp = F.col("l_orderkey"), F.col("l_suppkey").cast("string")
    amount = F.col("l_quantity").cast("int").cast("string")

    def every(n: int):
        return key % n == 0

    # The test file is one row group, which one task reads; its rows are dealt before they are rewritten.
    rows = table(spark, folder, "lineitem").select(*DIRTY_ORDER, "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate").repartition(*DIRTY_ORDER)
    return rows.select(
        *DIRTY_ORDER,
        F.concat(F.lit("Supplier "), supp).alias("entity_name"),
        F.when(every(97), F.lit("  ")).when(every(89), F.concat(F.lit("\t"), supp, F.lit(" "))).otherwise(supp).alias("entity_slug"),
        F.when(every(83), F.lit("unknown")).when(every(79), F.concat(F.lit("1,"), F.lpad(amount, 3, "0")))
        .otherwise((F.col("l_suppkey") + 100).cast("string")).alias("total_n"),
        F.concat(F.lit("Flag "), F.col("l_returnflag")).alias("tag_name"),
        F.lower("l_returnflag").alias("tag_slug"),
        F.when(every(73), F.lit("999999")).otherwise(amount).alias("tag_n"),
        F.when(every(71), F.lit("other")).when(every(67), F.lit("cedh_filtered_json")).otherwise(F.lit("commander_json")).alias("source_type"),
        F.when(every(61), F.lit("2026")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("observed_at"),
    )


def known_index(spark: SparkSession, folder: str) -> DataFrame:
    """Index of known entities: suppliers that are not overdrawn, their slugs padded."""
    return table(spark, folder, "supplier").where("s_acctbal >= 0").select(
        F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit("\t")).alias("entity_slug"))


DIRTY_RAW_SQL = r"""
raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, 'Supplier ' || l_suppkey AS entity_name,
    CASE WHEN l_orderkey % 97 = 0 THEN '  ' WHEN l_orderkey % 89 = 0 THEN chr(9) || l_suppkey || ' ' ELSE l_suppkey::VARCHAR END AS entity_slug,
    CASE WHEN l_orderkey % 83 = 0 THEN 'unknown' WHEN l_orderkey % 79 = 0 THEN '1,' || lpad(l_quantity::INT::VARCHAR, 3, '0')
         ELSE (100 + l_suppkey)::VARCHAR END AS total_n,
    'Flag ' || l_returnflag AS tag_name, lower(l_returnflag) AS tag_slug,
    CASE WHEN l_orderkey % 73 = 0 THEN '999999' ELSE l_quantity::INT::VARCHAR END AS tag_n,
    CASE WHEN l_orderkey % 71 = 0 THEN 'other' WHEN l_orderkey % 67 = 0 THEN 'cedh_filtered_json' ELSE 'commander_json' END AS source_type,
    CASE WHEN l_orderkey % 61 = 0 THEN '2026' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS observed_at
  FROM lineitem)
"""
DIRTY_SQL = DIRTY_RAW_SQL + r""",
norm AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, entity_name,
    trim(entity_slug, ' ' || chr(9)) AS entity_slug, TRY_CAST(replace(total_n, ',', '') AS BIGINT) AS total_n,
    CASE WHEN source_type = 'cedh_filtered_json' THEN 'cEDH' ELSE tag_name END AS tag_name,
    CASE WHEN source_type = 'cedh_filtered_json' THEN 'cedh' ELSE tag_slug END AS tag_slug,
    tag_n::BIGINT AS tag_n, source_type, observed_at
  FROM raw),
known AS (SELECT s_suppkey::VARCHAR AS k FROM supplier WHERE s_acctbal >= 0),
field_errors AS (
  SELECT *, concat_ws(', ', CASE WHEN entity_slug = '' THEN 'entity_slug:blank' END, CASE WHEN total_n IS NULL THEN 'total_n:not_a_count' END,
      CASE WHEN source_type = 'other' THEN 'source_type:unexpected' END, CASE WHEN observed_at = '2026' THEN 'observed_at:not_iso' END) AS field_error
  FROM norm),
broken AS (SELECT *, CASE WHEN field_error = '' AND tag_n > total_n THEN 'tag_n:above_total_n' ELSE field_error END AS broken FROM field_errors),
checked AS (
  SELECT *, CASE WHEN broken <> '' THEN 'schema_validation_error' WHEN entity_slug NOT IN (SELECT k FROM known) THEN 'unknown_commander_slug' END AS reason_type,
    CASE WHEN broken <> '' THEN broken WHEN entity_slug NOT IN (SELECT k FROM known) THEN 'entity is not in the index: ' || entity_slug END AS reason
  FROM broken),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY entity_name, entity_slug, total_n, tag_name, tag_slug, tag_n, source_type, observed_at
                               ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS copy_no
  FROM checked WHERE reason_type IS NULL),
versions AS (
  SELECT *, row_number() OVER (PARTITION BY entity_slug, tag_slug, source_type ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS version_no,
         count(*) OVER (PARTITION BY entity_slug, tag_slug, source_type) AS version_n
  FROM numbered WHERE copy_no = 1),
clean AS (SELECT entity_name, entity_slug, total_n, tag_name, tag_slug, tag_n, source_type, observed_at FROM versions WHERE version_no = 1)
"""
