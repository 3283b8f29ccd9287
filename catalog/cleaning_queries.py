"""Cleaning: clean rows, quarantine tables, entity and tag tables, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.config import CLEAN_COLUMNS, PAIR_KEY
from affinis.operators import checks, cleaning as cl
from affinis.session import materialise
from catalog.fixtures import DIRTY_ORDER, DIRTY_RAW_SQL, DIRTY_SQL, dirty, known_index
from catalog.registry import joined, query, table

RAW = "WITH " + DIRTY_RAW_SQL
WITH = "WITH " + DIRTY_SQL
ROW = "entity_name, entity_slug, total_n, tag_name, tag_slug, tag_n, source_type, observed_at"


def checked(spark, folder):
    return materialise(cl.check_rows(dirty(spark, folder), known_index(spark, folder)))


def cleaned(spark, folder):
    return cl.clean(checked(spark, folder), DIRTY_ORDER)


@query("clean_rows", WITH + f"SELECT {ROW} FROM clean")
def clean_rows(spark, folder):
    return cl.in_clean_order(cleaned(spark, folder).clean)


@query("clean_invalid", WITH + """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, reason_type, reason FROM checked WHERE reason_type IS NOT NULL""")
def clean_invalid(spark, folder):
    rows = cl.check_rows(dirty(spark, folder), known_index(spark, folder))
    return cl.clean(rows, DIRTY_ORDER).invalid.select(*DIRTY_ORDER, "reason_type", "reason")


@query("quarantine_unknown_entities", WITH + """
SELECT entity_slug, count(*) AS row_count, min(l_orderkey) AS first_order FROM checked
WHERE reason_type = 'unknown_commander_slug' GROUP BY entity_slug""")
def quarantine_unknown_entities(spark, folder):
    rows = cl.check_rows(dirty(spark, folder), known_index(spark, folder))
    return rows.where(F.col("reason_type") == cl.UNKNOWN_ENTITY).groupBy("entity_slug").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("l_orderkey").alias("first_order"))


@query("clean_exact_duplicates", WITH + f"SELECT {ROW} FROM numbered WHERE copy_no > 1")
def clean_exact_duplicates(spark, folder):
    return cleaned(spark, folder).exact_duplicates


@query("clean_conflicts", WITH + f"SELECT {ROW} FROM versions WHERE version_n > 1")
def clean_conflicts(spark, folder):
    return cl.in_key_order(cleaned(spark, folder).conflicts)


def two_inputs(raw):
    """The same rows as two inputs, one of normal and one of signal rows."""
    signal = F.col("source_type") == "cedh_filtered_json"
    return [("normal", raw.where(~signal), DIRTY_ORDER), ("signal", raw.where(signal), DIRTY_ORDER)]


# Both inputs joined as one bag.
@query("clean_keep_first", WITH + """
SELECT entity_slug, tag_slug, source_type, total_n, tag_n, version_n AS versions,
       CASE WHEN source_type = 'cedh_filtered_json' THEN 'signal' ELSE 'normal' END AS input_source
FROM versions WHERE version_no = 1""")
def clean_keep_first(spark, folder):
    bag = cl.union_inputs(two_inputs(dirty(spark, folder)))
    rows = cl.check_rows(bag, known_index(spark, folder)).where("reason_type IS NULL")
    distinct = rows.groupBy(*CLEAN_COLUMNS).agg(F.min_by(F.struct("input_source"), F.struct("input_rank", "input_row")).alias("_src"),
                                                F.min(F.struct("input_rank", "input_row")).alias("_place"))
    kept = cl.first_per_key(distinct, cl.CLEAN_KEY, ["_place"], {"versions": F.count(F.lit(1))})
    return kept.select(*cl.CLEAN_KEY, "total_n", "tag_n", "versions", F.col("_src.input_source").alias("input_source"))


@query("entities_clean", WITH + """
SELECT entity_slug, arg_min(entity_name, (source_type, tag_slug)) AS entity_name, max(total_n) AS total_n, count(*) AS tag_count,
       count(*) FILTER (WHERE source_type = 'commander_json') AS normal_tag_count, bool_or(source_type = 'cedh_filtered_json') AS has_cedh_tag,
       string_agg(DISTINCT source_type, '|' ORDER BY source_type) AS source_types, min(observed_at) AS first_observed_at,
       max(observed_at) AS latest_observed_at, coalesce(max(tag_n) FILTER (WHERE source_type = 'cedh_filtered_json'), 0) AS cedh_n
FROM clean GROUP BY entity_slug""")
def entities_clean(spark, folder):
    return cl.entities(cleaned(spark, folder).clean).withColumn("source_types", joined("source_types"))


@query("tags_dim", WITH + """
SELECT tag_slug, arg_min(tag_name, (entity_slug, source_type)) AS tag_name, count(DISTINCT entity_slug) AS entity_count,
       sum(tag_n)::BIGINT AS total_tag_n, string_agg(DISTINCT source_type, '|' ORDER BY source_type) AS source_types
FROM clean GROUP BY tag_slug""")
def tags_dim(spark, folder):
    return cl.tags(cleaned(spark, folder).clean).withColumn("source_types", joined("source_types"))


@query("validation_report", WITH + """
SELECT (SELECT count(*) FROM raw) AS total_input_row_count,
  (SELECT count(*) FROM checked WHERE reason_type IS NOT NULL) AS invalid_row_count,
  (SELECT count(*) FROM checked WHERE reason_type = 'schema_validation_error') AS schema_invalid_row_count,
  (SELECT count(*) FROM checked WHERE reason_type = 'unknown_commander_slug') AS unknown_entity_count,
  (SELECT count(*) FROM checked WHERE reason_type IS NULL) AS valid_row_count_before_duplicate_handling,
  (SELECT count(*) FROM clean) AS clean_tag_row_count,
  (SELECT count(*) FROM clean WHERE source_type = 'commander_json') AS normal_clean_row_count,
  (SELECT count(*) FROM clean WHERE source_type = 'cedh_filtered_json') AS cedh_clean_row_count,
  (SELECT count(DISTINCT entity_slug) FROM clean) AS unique_entity_count_in_clean_rows,
  (SELECT count(DISTINCT tag_slug) FROM clean) AS unique_tag_count_in_clean_rows,
  (SELECT count(*) FROM numbered WHERE copy_no > 1) AS exact_duplicate_row_count,
  (SELECT count(*) FROM versions WHERE version_n > 1 AND version_no = 1) AS conflicting_duplicate_key_count,
  (SELECT count(*) FROM versions WHERE version_n > 1) AS conflicting_duplicate_row_count,
  (SELECT count(*) FROM known) AS index_record_count, (SELECT count(*) FROM known) AS known_entity_slug_count,
  concat_ws('|', CASE WHEN (SELECT count(*) FROM checked WHERE reason_type IS NOT NULL) > 0 THEN 'rows failed validation' END,
    CASE WHEN (SELECT count(*) FROM versions WHERE version_n > 1) > 0 THEN 'rows conflict on entity, tag and source' END) AS warnings""")
def validation_report(spark, folder):
    index = known_index(spark, folder)
    result, seen = cl.cleaned_once(cl.check_rows(dirty(spark, folder), index), DIRTY_ORDER)
    return cl.validation_report(result, index, seen=seen).withColumn("warnings", joined("warnings"))


# Two inputs, and the status rows of a signal run: orders by status, those in process without one.
@query("validation_counts", WITH + """
SELECT 'source_type' AS kind, coalesce(source_type, '') AS value, count(*) AS row_count FROM checked GROUP BY ALL
UNION ALL SELECT 'reason', coalesce(reason_type, ''), count(*) FROM checked GROUP BY ALL
UNION ALL SELECT 'input', CASE WHEN source_type = 'cedh_filtered_json' THEN 'signal' ELSE 'normal' END, count(*) FROM checked GROUP BY ALL
UNION ALL SELECT 'status', CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END, count(*) FROM orders GROUP BY ALL""")
def validation_counts(spark, folder):
    bag = cl.union_inputs(two_inputs(dirty(spark, folder)))
    status = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status_type"))
    return cl.validation_counts(cl.check_rows(bag, known_index(spark, folder)), status)


@query("analysis_input_violations", RAW + """
, n AS (SELECT *, TRY_CAST(replace(total_n, ',', '') AS BIGINT) AS total, tag_n::BIGINT AS tag FROM raw)
SELECT count(*) FILTER (WHERE trim(entity_name) = '') AS entity_name_blank, count(*) FILTER (WHERE trim(entity_slug) = '') AS entity_slug_blank,
  count(*) FILTER (WHERE trim(tag_name) = '') AS tag_name_blank, count(*) FILTER (WHERE trim(tag_slug) = '') AS tag_slug_blank,
  count(*) FILTER (WHERE trim(source_type) = '') AS source_type_blank, count(*) FILTER (WHERE trim(observed_at) = '') AS observed_at_blank,
  count(*) FILTER (WHERE total IS NULL) AS total_n_not_numeric, count(*) FILTER (WHERE tag IS NULL) AS tag_n_not_numeric,
  count(*) FILTER (WHERE total <= 0) AS total_n_not_positive, count(*) FILTER (WHERE tag < 0) AS tag_n_negative,
  count(*) FILTER (WHERE tag > total) AS tag_n_above_total_n FROM n""")
def analysis_input_violations(spark, folder):
    return checks.input_violations(dirty(spark, folder))


@query("duplicate_key_samples", RAW + "SELECT entity_slug, tag_slug, count(*) AS row_count FROM raw GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_samples(spark, folder):
    return checks.repeated_keys(dirty(spark, folder), PAIR_KEY)


@query("missing_columns", """
SELECT 'total_n' AS column_name, count(*) AS row_count FROM lineitem UNION ALL SELECT 'observed_at', count(*) FROM lineitem""")
def missing_columns(spark, folder):
    """Required columns a table lacks, with the number of rows that cannot be analysed for it."""
    partial = dirty(spark, folder).drop("total_n", "observed_at")
    missing = checks.missing_columns(partial, CLEAN_COLUMNS)
    counted = partial.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.explode(F.array(*[F.lit(c) for c in missing])).alias("column_name"), "row_count")
