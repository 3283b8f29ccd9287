import pytest
from pyspark.sql import functions as F

from affinis.operators import snapshots as sn, trends as tr
from affinis.operators.checks import repeated_keys
from affinis.sources import snapshots as ss

SCHEMA = ("entity_name string, entity_slug string, tag_name string, tag_slug string, source_type string, total_n bigint, tag_n bigint, "
          "tag_affinity_pct double, z double, rank_within_tag_by_z int")


def row(slug, total, n, pct, z, rank, name=None):
    return (name or slug.title(), slug, "Tokens", "tokens", "commander_json", total, n, pct, z, rank)


CURRENT = [row("alpha", 120, 30, 0.25, 1.5, 7, "Alpha Now"), row("bravo", 100, 5, 0.05, 0.1, 5), row("newbie", 50, 5, 0.1, 0.3, 9)]
PREVIOUS = [row("alpha", 100, 20, 0.20, 1.0, 10), row("bravo", 0, 0, 0.0, 0.1, 4), row("removed", 10, 1, 0.1, None, None)]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(CURRENT, SCHEMA), spark.createDataFrame(PREVIOUS, SCHEMA)


def test_statuses_and_differences(frames):
    rows = {r["entity_slug"]: r for r in tr.trends(*frames, "2026-05-21", "2026-05-14").collect()}
    assert {s: r["snapshot_status"] for s, r in rows.items()} == {"alpha": "existing", "bravo": "existing", "newbie": "new_pair", "removed": "removed_pair"}
    a = rows["alpha"]
    assert (a["total_n_delta"], a["tag_n_delta"], a["rank_delta"], a["rank_within_tag_by_z_delta"]) == (20, 10, 3, 3)
    assert a["affinity_pct_delta"] == pytest.approx(0.05) and a["z_delta"] == pytest.approx(0.5)
    assert a["total_n_pct_change"] == pytest.approx(0.2) and a["tag_n_pct_change"] == pytest.approx(0.5)
    assert a["entity_name"] == "Alpha Now" and rows["removed"]["entity_name"] == "Removed"
    assert rows["bravo"]["rank_delta"] == -1 and rows["bravo"]["total_n_pct_change"] is None
    assert rows["removed"]["total_n_delta"] is None and rows["newbie"]["z_delta"] is None


def test_attached_rows_keep_to_the_current_ones(frames):
    current, previous = frames
    trend = tr.trends(current, previous, "2026-05-21", "2026-05-14")
    attached = tr.attach_trends(current, trend)
    assert sorted(r["entity_slug"] for r in attached.collect()) == ["alpha", "bravo", "newbie"]
    s = tr.trend_summary(trend, current, previous).first()
    assert (s["existing_pair_count"] + s["new_pair_count"], s["existing_pair_count"] + s["removed_pair_count"]) == (3, 3)
    assert (s["trend_row_count"], s["rows_with_z_delta"], s["no_previous_snapshot_count"]) == (4, 2, 0)


def test_first_run(frames):
    current, _ = frames
    trend = tr.trends(current, None, "2026-05-21", None)
    assert {r["snapshot_status"] for r in trend.collect()} == {"no_previous_snapshot"}
    first = trend.first()
    assert first["z_delta"] is None and first["rank_delta"] is None and first["previous_snapshot"] is None and first["total_n_current"] is not None
    assert set(tr.trends(*frames, "a", "b").columns) == set(trend.columns)
    # the attached rows keep their own figures beside the trend columns, none of them twice
    attached = tr.attach_trends(current, trend)
    assert len(attached.columns) == len(set(attached.columns)) and attached.first()["total_n"] is not None


def test_repeated_keys_are_refused(spark, frames):
    twice = spark.createDataFrame(CURRENT + [row("alpha", 1, 1, 0.1, 0.1, 1)], SCHEMA)
    with pytest.raises(ValueError, match="alpha"):
        tr.trends(twice, frames[1], "a", "b")
    with pytest.raises(ValueError, match="tag_slug"):
        tr.trends(frames[0].drop("tag_slug"), frames[1], "a", "b")


def test_missing_metric_columns_give_empty_figures(frames):
    got = tr.trends(frames[0].drop("z"), frames[1].drop("z"), "a", "b").first()
    assert got["z_delta"] is None and got["total_n_current"] is not None or got["total_n_previous"] is not None


SIZES = [("2026-05-07", 5), ("2026-05-14", 3), ("2026-05-18", 0), ("2026-05-21", 0), ("latest", 9), ("2026-06-01", 4)]


def test_choice_of_snapshot(spark):
    sizes = spark.createDataFrame(SIZES, "snapshot_date string, row_count bigint")
    assert sn.previous_snapshot(sizes, "2026-05-21").first()[0] == "2026-05-18"
    assert sn.previous_snapshot(sizes, "2026-05-07").first()[0] is None
    assert sn.latest_filled(sizes, "2026-05-21").first()[:] == ("2026-05-14", 3)
    assert sn.latest_filled(sizes, "latest").first()[:] == ("2026-06-01", 4)
    before = {r["snapshot_date"]: r["previous_snapshot"] for r in sn.previous_snapshots(sizes).collect()}
    assert before["2026-05-14"] == "2026-05-07" and "latest" not in before
    assert sn.fallback_report(sizes, "2026-05-21").first()[1:] == (0, True, "2026-05-14", 3)
    assert sn.fallback_report(sizes, "2026-05-14").first()[1:] == (3, False, None, None)


def test_size_out_of_a_report(spark):
    df = spark.createDataFrame([("7", 3), ("x", 3), (None, 2)], "said string, counted bigint")
    assert [r[0] for r in df.select(sn.reported_size(F.col("said"), F.col("counted"))).collect()] == [7, 3, 2]


def test_reports_tell_the_size_where_they_can(spark):
    sizes = spark.createDataFrame([("2026-05-07", 5), ("2026-05-14", 3)], "snapshot_date string, row_count bigint")
    reports = spark.createDataFrame([("2026-05-07", " 0 "), ("2026-05-14", "many"), ("2026-05-21", "8"), ("2026-05-28", None)], "snapshot_date string, clean_tag_row_count string")
    got = {r["snapshot_date"]: r["row_count"] for r in sn.sized_by_reports(sizes, reports).collect()}
    assert got == {"2026-05-07": 0, "2026-05-14": 3, "2026-05-21": 8}


def test_stored_by_pair_nothing_is_shuffled(spark, frames, tmp_path):
    """Snapshots in buckets are checked, compared and attached without an exchange; rows are those of the plain way."""
    root = str(tmp_path / "by-pair")
    for name, rows in zip(("2026-05-21", "2026-05-14"), frames):
        ss.store_by_pair(rows, root, name, 3)
    ss.store_by_pair(frames[0], root, "2026-05-21", 5)  # written again; the table stays at three buckets
    now, before = (ss.open_by_pair(spark, root, name) for name in ("2026-05-21", "2026-05-14"))
    assert ss.by_pair_names(spark, root) == ["2026-05-14", "2026-05-21"] and len(list((tmp_path / "by-pair" / "2026-05-21").glob("buckets=*"))) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = tr.trends(now, before, "2026-05-21", "2026-05-14"), tr.attach_previous(now, before, "2026-05-21", "2026-05-14")
        for df in made:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert "Exchange" not in repeated_keys(now)._jdf.queryExecution().executedPlan().toString()
        plain = tr.trends(*frames, "2026-05-21", "2026-05-14")
        assert sorted(map(str, made[0].collect())) == sorted(map(str, plain.collect()))
        attached = tr.attach_trends(frames[0], plain)
        assert sorted(map(str, made[1].select(*attached.columns).collect())) == sorted(map(str, attached.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(FileNotFoundError):
        ss.open_by_pair(spark, root, "2026-05-07")


def test_first_run_is_attached_as_before(frames):
    plain = tr.attach_trends(frames[0], tr.trends(frames[0], None, "2026-05-21", None))
    one = tr.attach_previous(frames[0], None, "2026-05-21", None)
    assert one.columns == plain.columns and sorted(map(str, one.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name, current, before", [
    ("2026-05-07", "2026-05-14", True), ("2026-05-14", "2026-05-14", False), ("2026-05-21", "2026-05-14", False), ("latest", "2026-05-14", False),
    ("2026-02-30", "2026-05-14", False), ("2026-05-21", "newest", True), ("newest", "newest", False), ("2026-05-07", "2026-13-01", True),
])
def test_older_snapshots(name, current, before):
    assert sn.is_before(name, current) is before
