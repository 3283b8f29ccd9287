"""Raw tag rows to the clean fact table, with every rejected row kept in a side table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from affinis.config import (
    CLEAN_COLUMNS, CLEAN_KEY, NORMAL_SOURCE, SIGNAL_NAME, SIGNAL_SLUG, SIGNAL_SOURCE, TEXT_COLUMNS,
)
from affinis.functions.numbers import count_of
from affinis.functions.text import bind, blank_to_null, strip_bare
from affinis.functions.times import valid_iso
from affinis.operators.keep_first import first_per_key, ordinal
from affinis.operators.reports import count_rows, report
from affinis.session import stored

# Reasons for which a row is set aside.
SCHEMA_ERROR = "schema_validation_error"
UNKNOWN_ENTITY = "unknown_commander_slug"
#: Copies of one row that are written out in one go.
COPIES = 10_000


def with_source(df: DataFrame, source: str, rank: int, order: Sequence[str]) -> DataFrame:
    """Lineage columns of one input: its name, its rank among the inputs, the row order in it."""
    return df.select("*", F.lit(source).alias("input_source"), F.lit(rank).alias("input_rank"),
                     ordinal(order).alias("input_row"))


def union_inputs(inputs: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """All inputs in order, one bag. Each comes as (name, rows, ordinal columns)."""
    tagged = [with_source(df, name, i, order) for i, (name, df, order) in enumerate(inputs)]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def normalise(raw: DataFrame) -> DataFrame:
    """Strip texts, read counts, and give signal rows their fixed tag."""
    types = {f.name: f.dataType for f in raw.schema.fields}

    def text(name: str):
        return strip_bare(F.col(name).cast("string")) if name in types else F.lit(None).cast("string")

    def count(name: str):
        return count_of(name, types[name]) if name in types else F.lit(None).cast("bigint")

    made = {c: text(c) for c in TEXT_COLUMNS} | {c: count(c) for c in ("total_n", "tag_n")}
    signal = made["source_type"] == SIGNAL_SOURCE
    made["tag_slug"] = F.when(signal, F.lit(SIGNAL_SLUG)).otherwise(made["tag_slug"])
    made["tag_name"] = F.when(signal, F.lit(SIGNAL_NAME)).otherwise(made["tag_name"])
    extras = [c for c in raw.columns if c not in CLEAN_COLUMNS]
    return raw.select(*extras, *[made[c].alias(c) for c in CLEAN_COLUMNS])


def broken_rules():
    """Codes of the rules a normalised row breaks, in rule order. How the counts relate is only
    asked of a row whose fields are all good."""
    total, tag, source = F.col("total_n"), F.col("tag_n"), F.col("source_type")
    blank = {c: F.coalesce(F.col(c), F.lit("")) == "" for c in TEXT_COLUMNS}
    rules = [(f"{c}:blank", blank[c]) for c in TEXT_COLUMNS]
    rules += [
        ("total_n:not_a_count", total.isNull()),
        ("total_n:not_positive", total <= 0),
        ("tag_n:not_a_count", tag.isNull()),
        ("tag_n:negative", tag < 0),
        ("source_type:unexpected", ~blank["source_type"] & ~source.isin(NORMAL_SOURCE, SIGNAL_SOURCE)),
        ("observed_at:not_iso", ~blank["observed_at"] & ~valid_iso("observed_at")),
    ]
    fields = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))
    above = F.array(F.lit("tag_n:above_total_n"))
    broken = bind(fields, lambda f: F.when((F.size(f) == 0) & (tag > total), above).otherwise(f))
    # The list is made by functions that Spark does not compile, so only rows that break a rule come to it; the tests alone are compiled.
    return F.when(reduce(or_, [test for _, test in rules]) | (tag > total), broken).otherwise(F.array().cast("array<string>"))


def known_slugs(index: DataFrame) -> DataFrame:
    return index.select(blank_to_null("entity_slug").alias("entity_slug")).where("entity_slug IS NOT NULL").distinct()


def check_rows(raw: DataFrame, index: DataFrame) -> DataFrame:
    """Normalised rows with `reason_type` and `reason`, both null for a good row.

    Whether the entity is known is only asked of rows that keep every rule.
    """
    kept = raw.withColumn("_raw", F.struct(*raw.columns))
    checked = normalise(kept).withColumn("_broken", broken_rules())
    known = known_slugs(index).withColumn("_known", F.lit(True))
    broken = F.size("_broken") > 0
    return (
        checked.join(known, "entity_slug", "left")
        .withColumn("reason_type", F.when(broken, SCHEMA_ERROR).when(F.col("_known").isNull(), UNKNOWN_ENTITY))
        .withColumn("reason", F.when(broken, F.array_join("_broken", ", ")).when(
            F.col("_known").isNull(), F.concat(F.lit("entity is not in the index: "), F.col("entity_slug"))))
        .withColumn("raw_record", F.when(F.col("reason_type").isNotNull(), F.to_json("_raw")))
        .drop("_broken", "_known", "_raw")
    )


@dataclass(frozen=True)
class Cleaned:
    """Tables of one cleaning run."""

    checked: DataFrame
    clean: DataFrame
    invalid: DataFrame
    exact_duplicates: DataFrame
    conflicts: DataFrame


def repeated(df: DataFrame, times: str, place: str) -> DataFrame:
    """Each row as often as its column `times` says; rows with very many copies are spread over tasks first. `place` is unique."""
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / COPIES)))
    cut = df.where(F.col(times) > 0).withColumn("_part", part).repartition(place, "_part")
    return cut.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col(times) - F.col("_part") * COPIES).cast("int")))).drop("_part", "_copy")


def checked_figures() -> dict[str, Column]:
    return {
        "total_input_row_count": count_rows(),
        "invalid_row_count": F.count_if(F.col("reason_type").isNotNull()),
        "schema_invalid_row_count": F.count_if(F.col("reason_type") == SCHEMA_ERROR),
        "unknown_entity_count": F.count_if(F.col("reason_type") == UNKNOWN_ENTITY),
        "valid_row_count_before_duplicate_handling": F.count_if(F.col("reason_type").isNull()),
    }


def clean_figures() -> dict[str, Column]:
    return {
        "clean_tag_row_count": count_rows(),
        "normal_clean_row_count": F.count_if(F.col("source_type") == NORMAL_SOURCE),
        "cedh_clean_row_count": F.count_if(F.col("source_type") == SIGNAL_SOURCE),
    }


def version_figures() -> dict[str, Column]:
    """Of rows that know how many versions they were chosen from."""
    several = F.when(F.col("_versions") > 1, F.col("_versions"))
    return {"conflicting_duplicate_key_count": F.count(several), "conflicting_duplicate_row_count": F.coalesce(F.sum(several), F.lit(0))}


def clean(checked: DataFrame, order: Sequence[str], keep: Callable[[DataFrame, dict[str, Column]], DataFrame] = lambda df, _: df) -> Cleaned:
    """Split checked rows into clean rows, rejected rows, exact copies and conflicting rows.

    `order` names the columns whose values, taken together, give each row its place in the
    input; they must be unique. `keep` gets each table that later steps read, with figures of its rows, and gives the table to go on from.
    """
    lineage = [c for c in checked.columns if c not in CLEAN_COLUMNS and c not in ("reason_type", "reason", "raw_record")]
    checked = keep(checked, checked_figures())
    invalid = checked.where("reason_type IS NOT NULL").select(*lineage, "reason_type", "reason", "raw_record")
    valid = checked.where("reason_type IS NULL").select(*CLEAN_COLUMNS, ordinal(order).alias("_place"))
    # Spark sorts rows to find the least struct of a group. Sorted by the key first, they need no second sort for the first row of each key; then the numbers, which compare fastest.
    by = [*CLEAN_KEY, "tag_n", "total_n", "observed_at"]
    by += [c for c in CLEAN_COLUMNS if c not in by]
    counted = keep(valid.groupBy(*by).agg(F.min("_place").alias("_place"), (count_rows() - 1).alias("_copies")),
                   {"exact_duplicate_row_count": F.coalesce(F.sum("_copies"), F.lit(0))})
    # Copies are equal in every column, so they are written from their count; no row is looked up again.
    copies = repeated(counted, "_copies", "_place").select(*CLEAN_COLUMNS)
    distinct = counted.drop("_copies")
    keyed = keep(first_per_key(distinct, CLEAN_KEY, ["_place"], {"_versions": count_rows()}), clean_figures() | version_figures())
    doubtful = keyed.where("_versions > 1").select(*CLEAN_KEY)
    conflicts = distinct.join(doubtful, list(CLEAN_KEY), "left_semi")
    return Cleaned(
        checked=checked,
        clean=keyed.select(*CLEAN_COLUMNS),
        invalid=invalid,
        exact_duplicates=copies,
        conflicts=conflicts.select(*CLEAN_COLUMNS),
    )


def cleaned_once(checked: DataFrame, order: Sequence[str]) -> tuple[Cleaned, dict[str, int]]:
    """clean() with every table in between stored once, and the figures that were taken while they were written."""
    seen: dict[str, int] = {}

    def keep(df: DataFrame, figures: dict[str, Column]) -> DataFrame:
        kept, got = stored(df, figures)
        seen.update(got)
        return kept

    return clean(checked, order, keep), seen


def in_clean_order(clean_rows: DataFrame) -> DataFrame:
    return clean_rows.orderBy("entity_slug", "source_type", "tag_slug")


def in_key_order(conflicts: DataFrame) -> DataFrame:
    return conflicts.orderBy(*CLEAN_KEY)


def entities(clean_rows: DataFrame) -> DataFrame:
    """One row per entity."""
    signal = F.col("source_type") == SIGNAL_SOURCE
    grouped = clean_rows.groupBy("entity_slug").agg(
        F.min_by("entity_name", F.struct("source_type", "tag_slug")).alias("entity_name"),
        F.max("total_n").alias("total_n"),
        F.count("tag_slug").alias("tag_count"),
        F.count_if(F.col("source_type") == NORMAL_SOURCE).alias("normal_tag_count"),
        F.bool_or(signal).alias("has_cedh_tag"),
        F.array_sort(F.collect_set("source_type")).alias("source_types"),
        F.min("observed_at").alias("first_observed_at"),
        F.max("observed_at").alias("latest_observed_at"),
        F.coalesce(F.max(F.when(signal, F.col("tag_n"))), F.lit(0)).alias("cedh_n"),
    )
    return grouped.orderBy("entity_name", "entity_slug")


def tags(clean_rows: DataFrame) -> DataFrame:
    """One row per tag; its name is the one in the first row by entity and source."""
    grouped = clean_rows.groupBy("tag_slug").agg(
        F.min_by("tag_name", F.struct("entity_slug", "source_type")).alias("tag_name"),
        F.countDistinct("entity_slug").alias("entity_count"),
        F.sum("tag_n").alias("total_tag_n"),
        F.array_sort(F.collect_set("source_type")).alias("source_types"),
    )
    return grouped.orderBy("tag_name", "tag_slug")


def status_counts(status: DataFrame) -> DataFrame:
    """Number of rows of each status; a blank or missing status counts as 'unknown'."""
    kind = F.coalesce(blank_to_null("status_type"), F.lit("unknown"))
    return status.groupBy(kind.alias("status_type")).agg(count_rows().alias("row_count")).orderBy("status_type")


def validation_counts(checked: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Rows by input (where rows name one), source type and reason, and by status: (kind, value, row_count). A good row's reason is ''."""
    kinds = {"source_type": F.col("source_type"), "reason": F.col("reason_type")}
    if "input_source" in checked.columns:
        kinds["input"] = F.col("input_source")
    pairs = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(value, F.lit("")).alias("value")) for kind, value in kinds.items()]))
    counts = checked.select(pairs.alias("pair")).select("pair.*").groupBy("kind", "value").agg(count_rows().alias("row_count"))
    if status is None:
        return counts
    return counts.unionAll(status_counts(status).select(F.lit("status").alias("kind"), F.col("status_type").alias("value"), "row_count"))


def validation_report(result: Cleaned, index: DataFrame, status: DataFrame | None = None, seen: dict[str, int] | None = None) -> DataFrame:
    """One row of figures on a cleaning run, with warnings. Figures in `seen` are known from writing the tables; only the others are counted."""
    seen = seen or {}
    slug = blank_to_null("entity_slug")
    parts = [
        (result.checked, checked_figures()),
        (result.clean, clean_figures()),
        (result.clean, {"unique_entity_count_in_clean_rows": F.count_distinct("entity_slug"), "unique_tag_count_in_clean_rows": F.count_distinct("tag_slug")}),
        (result.exact_duplicates, {"exact_duplicate_row_count": count_rows()}),
        (result.conflicts.groupBy(*CLEAN_KEY).agg(count_rows().alias("_versions")), version_figures()),
        (index, {"index_record_count": count_rows(), "known_entity_slug_count": F.count_distinct(slug)}),
    ]
    if status is not None:
        bad = F.col("status_type").contains("error") | F.col("status_type").contains("parse")
        parts.append((status, {"signal_error_status_count": F.count_if(bad)}))
    names = [name for _, figures in parts for name in figures]
    left = [(df, {n: c for n, c in figures.items() if n not in seen}) for df, figures in parts]
    figures = report([part for part in left if part[1]]).select(*[F.lit(seen[n]).cast("bigint").alias(n) if n in seen else n for n in names])
    errors = F.col("signal_error_status_count") if status is not None else F.lit(0)
    return figures.withColumn("warnings", F.array_compact(F.array(
        F.when(F.col("invalid_row_count") > 0, F.lit("rows failed validation")),
        F.when(F.col("conflicting_duplicate_row_count") > 0, F.lit("rows conflict on entity, tag and source")),
        F.when(errors > 0, F.lit("signal statuses hold errors")),
    )))
