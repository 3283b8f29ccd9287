"""Trends between two snapshots and choice of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis.config import PAIR_KEY
from affinis.operators import affinity as af, snapshots as sn, trends as tr
from affinis.session import materialise, new_path
from affinis.sources import snapshots as ss
from catalog.fixtures import HALVES, HALVES_SQL, MIDDLE, STRICT, YEARS_SQL, halves, tasks_for, years
from catalog.registry import query, rounded

PREVIOUS, CURRENT = HALVES
WITH = "WITH " + HALVES_SQL
METRIC_SQL = ""
for name, source in (("total_n", "total_n"), ("tag_n", "tag_n"), ("affinity_pct", "tag_affinity_pct"), ("z", "z")):
    whole = name.endswith("_n")
    fmt = (lambda e: e) if whole else (lambda e: f"round({e}, 6)")
    METRIC_SQL += f", {fmt('c.' + source)} AS {name}_current, {fmt('p.' + source)} AS {name}_previous, {fmt(f'c.{source} - p.{source}')} AS {name}_delta"
METRIC_SQL += """, c.rank_within_tag_by_z AS rank_within_tag_by_z_current, p.rank_within_tag_by_z AS rank_within_tag_by_z_previous,
  p.rank_within_tag_by_z - c.rank_within_tag_by_z AS rank_within_tag_by_z_delta, p.rank_within_tag_by_z - c.rank_within_tag_by_z AS rank_delta,
  round((c.total_n - p.total_n)::DOUBLE / nullif(p.total_n, 0), 6) AS total_n_pct_change,
  round((c.tag_n - p.tag_n)::DOUBLE / nullif(p.tag_n, 0), 6) AS tag_n_pct_change"""
TRENDS = WITH + f""", trend_rows AS (
  SELECT coalesce(c.entity_slug, p.entity_slug) AS entity_slug, coalesce(c.tag_slug, p.tag_slug) AS tag_slug,
    coalesce(c.entity_name, p.entity_name) AS entity_name, coalesce(c.tag_name, p.tag_name) AS tag_name,
    coalesce(c.source_type, p.source_type) AS source_type, '{CURRENT}' AS current_snapshot, '{PREVIOUS}' AS previous_snapshot,
    CASE WHEN p.entity_slug IS NULL THEN 'new_pair' WHEN c.entity_slug IS NULL THEN 'removed_pair' ELSE 'existing' END AS snapshot_status
    {METRIC_SQL}
  FROM c_affinity c FULL JOIN p_affinity p ON c.entity_slug = p.entity_slug AND c.tag_slug = p.tag_slug)
"""


def scored(rows, name):
    return af.analyse(rows.where(F.col("snapshot_date") == name).drop("snapshot_date"), STRICT, check=False)


def by_pair(rows, n):
    """Rows dealt by pair key in as many tasks as n rows ask for; a join by that key goes on from there. Dealt by size, few bytes of many rows fill few tasks."""
    return rows.repartition(tasks_for(rows.sparkSession, n), *PAIR_KEY)


def both(spark, folder):
    rows = materialise(halves(spark, folder))
    n = rows.count()
    return by_pair(scored(rows, CURRENT), n), by_pair(scored(rows, PREVIOUS), n)


def stored_by_pair(spark, folder):
    """Both snapshots, written in buckets and opened again."""
    root, rows = new_path(spark, "by-pair"), materialise(halves(spark, folder))
    for name in (CURRENT, PREVIOUS):
        ss.store_by_pair(scored(rows, name), root, name, tasks_for(spark, rows.count()))
    return ss.open_by_pair(spark, root, CURRENT), ss.open_by_pair(spark, root, PREVIOUS)


def trend_frame(spark, folder):
    current, previous = both(spark, folder)
    return tr.trends(current, previous, CURRENT, PREVIOUS, check=False)


@query("trend_rows", TRENDS + "SELECT * FROM trend_rows")
def trend_rows(spark, folder):
    return rounded(trend_frame(spark, folder))


@query("trend_first_run", WITH + f"""
SELECT entity_slug, tag_slug, entity_name, tag_name, source_type, '{CURRENT}' AS current_snapshot, NULL::VARCHAR AS previous_snapshot,
  'no_previous_snapshot' AS snapshot_status, total_n AS total_n_current, NULL::BIGINT AS total_n_previous, NULL::BIGINT AS total_n_delta,
  tag_n AS tag_n_current, NULL::BIGINT AS tag_n_previous, NULL::BIGINT AS tag_n_delta, round(tag_affinity_pct, 6) AS affinity_pct_current,
  NULL::DOUBLE AS affinity_pct_previous, NULL::DOUBLE AS affinity_pct_delta, round(z, 6) AS z_current, NULL::DOUBLE AS z_previous,
  NULL::DOUBLE AS z_delta, rank_within_tag_by_z AS rank_within_tag_by_z_current, NULL::BIGINT AS rank_within_tag_by_z_previous,
  NULL::INT AS rank_within_tag_by_z_delta, NULL::INT AS rank_delta, NULL::DOUBLE AS total_n_pct_change, NULL::DOUBLE AS tag_n_pct_change
FROM c_affinity""")
def trend_first_run(spark, folder):
    current = scored(materialise(halves(spark, folder)), CURRENT)
    return rounded(tr.trends(current, None, CURRENT, None, check=False))


@query("affinity_with_trends", TRENDS + """
SELECT c.entity_slug, c.tag_slug, c.total_n, c.tag_n, round(c.z, 6) AS z, c.analysis_eligible, t.snapshot_status, t.total_n_delta, t.tag_n_delta,
       t.z_delta, t.rank_delta, t.tag_n_pct_change
FROM c_affinity c JOIN trend_rows t USING (entity_slug, tag_slug) WHERE t.snapshot_status <> 'removed_pair'""")
def affinity_with_trends(spark, folder):
    current, previous = both(spark, folder)
    current = materialise(current)
    current = by_pair(current, current.count())
    rows = tr.attach_trends(current, tr.trends(current, previous, CURRENT, PREVIOUS, check=False))
    return rounded(rows.select("entity_slug", "tag_slug", "total_n", "tag_n", "z", "analysis_eligible", "snapshot_status",
                               "total_n_delta", "tag_n_delta", "z_delta", "rank_delta", "tag_n_pct_change"))


@query("trend_summary", TRENDS + """
SELECT count(*) AS trend_row_count, count(*) FILTER (WHERE snapshot_status = 'existing') AS existing_pair_count,
  count(*) FILTER (WHERE snapshot_status = 'new_pair') AS new_pair_count, count(*) FILTER (WHERE snapshot_status = 'removed_pair') AS removed_pair_count,
  0::BIGINT AS no_previous_snapshot_count, count(total_n_delta) AS rows_with_total_n_delta, count(tag_n_delta) AS rows_with_tag_n_delta,
  count(affinity_pct_delta) AS rows_with_affinity_pct_delta, count(z_delta) AS rows_with_z_delta, count(rank_delta) AS rows_with_rank_delta,
  (SELECT count(*) FROM cur_rows) AS current_row_count, (SELECT count(*) FROM prev_rows) AS previous_row_count FROM trend_rows""")
def trend_summary(spark, folder):
    current, previous = both(spark, folder)
    rows = materialise(tr.trends(current, previous, CURRENT, PREVIOUS, check=False))
    return tr.trend_summary(rows, current.select("entity_slug"), previous.select("entity_slug"))


@query("previous_snapshot", "WITH " + YEARS_SQL + """
SELECT snapshot_date, count(*) AS row_count, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS previous_snapshot FROM dated GROUP BY snapshot_date""")
def previous_snapshot(spark, folder):
    return sn.previous_snapshots(sn.sizes_of(years(spark, folder)))


# A snapshot that holds no rows and a folder that is no date stand beside the filled ones; some
# snapshots tell their size in a report, the report of others is of no use.
@query("snapshot_fallback", "WITH " + YEARS_SQL + """
SELECT '2002-01-01' AS current_snapshot, 0::BIGINT AS current_row_count, true AS fallback_used,
       max(snapshot_date) AS fallback_snapshot, arg_max(n, snapshot_date) AS fallback_row_count
FROM (SELECT snapshot_date, count(*) AS n FROM dated GROUP BY snapshot_date)""")
def snapshot_fallback(spark, folder):
    sizes = materialise(sn.sizes_of(years(spark, folder)))
    empty = spark.createDataFrame([("2002-01-01", 0), ("2001-12-31", 0), ("latest", 7)], "snapshot_date string, row_count bigint")
    told = F.when(F.col("snapshot_date") < MIDDLE, F.col("row_count").cast("string")).otherwise("n/a")
    reports = sizes.select("snapshot_date", told.alias("clean_tag_row_count"))
    return sn.fallback_report(sn.sized_by_reports(sizes.unionByName(empty), reports), "2002-01-01")


@query("stored_trend_rows", TRENDS + "SELECT * FROM trend_rows")
def stored_trend_rows(spark, folder):
    """Both snapshots stored in buckets by pair key and compared where they lie."""
    return rounded(tr.trends(*stored_by_pair(spark, folder), CURRENT, PREVIOUS, check=True))


@query("stored_affinity_with_trends", TRENDS + """
SELECT c.entity_slug, c.tag_slug, c.total_n, c.tag_n, round(c.z, 6) AS z, c.analysis_eligible, t.snapshot_status, t.total_n_delta, t.tag_n_delta,
       t.z_delta, t.rank_delta, t.tag_n_pct_change
FROM c_affinity c JOIN trend_rows t USING (entity_slug, tag_slug) WHERE t.snapshot_status <> 'removed_pair'""")
def stored_affinity_with_trends(spark, folder):
    """Rows of the current snapshot with their trends, from the snapshots in buckets."""
    rows = tr.attach_previous(*stored_by_pair(spark, folder), CURRENT, PREVIOUS)
    return rounded(rows.select("entity_slug", "tag_slug", "total_n", "tag_n", "z", "analysis_eligible", "snapshot_status",
                               "total_n_delta", "tag_n_delta", "z_delta", "rank_delta", "tag_n_pct_change"))
