"""One key that holds a third of all rows or more."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from affinis.operators import affinity as af, cleaning as cl, explore as ex
from affinis.sinks import shards as sh
from affinis.sources import documents as dm
from catalog import QUERIES, fixtures

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "300KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300KB",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "48",
}


@pytest.fixture
def large_tables(spark):
    """Settings under which small test rows are planned as large tables are."""
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def hot_facts(spark, n):
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.concat(F.lit("entity-"), F.col("id").cast("string")).alias("entity_slug"), F.concat(F.lit("Entity "), F.xxhash64("id").cast("string")).alias("entity_name"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("tag_slug"), F.lit("T").alias("tag_name"),
        F.lit(500).cast("bigint").alias("total_n"), F.when(hot & (F.col("id") % 9 != 0), 7).otherwise(F.col("id") % 400).cast("bigint").alias("tag_n"),
        F.lit("commander_json").alias("source_type"), F.lit("2026-05-07").alias("observed_at"))


def test_hot_value_of_a_hot_tag_is_split(spark, large_tables, tmp_path):
    path = str(tmp_path / "facts")
    n = 200_000
    hot_facts(spark, n).write.parquet(path)
    facts = spark.read.parquet(path)
    everything = af.analyse(facts, check=False).agg(
        F.count("z").alias("n"), F.max(F.concat("entity_slug", "entity_name", "rank_within_tag_by_tag_n", "rank_within_tag_by_z")).alias("m"))
    assert everything.collect()[0]["n"] == n
    plan = plan_of(everything).split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin(skew=true)") >= 2
    got = af.analyse(facts, check=False).where("tag_slug = 'hot'").groupBy("tag_n").agg(F.min("rank_within_tag_by_pct").alias("r"), F.count("*").alias("n"))
    ranks = {r["tag_n"]: (r["r"], r["n"]) for r in got.collect()}
    above = 0
    for value in sorted(ranks, reverse=True):
        assert ranks[value][0] == above + 1
        above += ranks[value][1]


def test_a_third_of_the_rows_are_copies_of_one(spark, large_tables):
    n = 30_000
    copy = F.col("id") % 3 == 0
    slug = F.when(copy, "same").otherwise(F.concat(F.lit("e"), F.col("id").cast("string")))
    raw = spark.range(n).select(
        F.col("id").alias("row"), slug.alias("entity_slug"), F.lit("N").alias("entity_name"), F.lit("100").alias("total_n"), F.lit("T").alias("tag_name"),
        F.lit("t").alias("tag_slug"), F.when(copy & (F.col("id") % 2 == 0), "5").otherwise("6").alias("tag_n"), F.lit("commander_json").alias("source_type"),
        F.lit("2026-05-07").alias("observed_at"))
    index = raw.select("entity_slug").distinct()
    result = cl.clean(cl.check_rows(raw, index), ["row"])
    assert result.clean.count() == n * 2 // 3 + 1
    assert result.exact_duplicates.count() == n // 3 - 2
    assert result.conflicts.count() == 2
    assert result.clean.where("entity_slug = 'same'").first()["tag_n"] == 5
    assert "Window" not in plan_of(result.clean)


def test_strongest_tags_of_a_hot_entity_are_cut_before_the_shuffle(spark):
    rows = spark.range(20_001).select(F.when(F.col("id") < 20_000, "hot").otherwise("cold").alias("entity_slug"), F.col("id").cast("string").alias("tag_slug"), F.col("id").cast("double").alias("z"), F.lit(1).alias("tag_n"))
    best = ex.best_tags(rows)
    assert sorted(r["tag_slug"] for r in best.collect() if r["entity_slug"] == "hot") == ["19995", "19996", "19997", "19998", "19999"]
    assert "WindowGroupLimit" in plan_of(best)


def small_tables(spark, root, n=1000):
    spark.range(n).selectExpr("id % 50 l_partkey", "id % 400 l_orderkey", "id % 40 l_suppkey").write.parquet(f"{root}/lineitem.parquet")
    spark.range(50).selectExpr("id p_partkey", "'Brand#' || (id % 5) p_brand").write.parquet(f"{root}/part.parquet")
    spark.range(400).selectExpr("id o_orderkey", "id % 7 o_custkey", "DATE'1997-01-01' o_orderdate").write.parquet(f"{root}/orders.parquet")
    spark.range(40).selectExpr("id s_suppkey").write.parquet(f"{root}/supplier.parquet")
    return str(root)


def tasks_of(files):
    """Numbers of the tasks that wrote the files."""
    return {re.search(r"part-(\d+)", f)[1] for f in files}


def test_rows_of_snapshots_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """The join of line items with orders has more tasks where there are more rows, however few bytes they have."""
    monkeypatch.setattr(fixtures, "DEALT", 10)
    rows = fixtures.years(spark, small_tables(spark, tmp_path))
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, 100\), REPARTITION_BY_NUM", plan_of(rows))
    assert sum(r["tag_n"] for r in rows.collect()) == 400


def test_joins_and_groupings_of_snapshots_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """No step between the line items and the pairs of two snapshots is dealt by bytes, and the rows stay those of the SQL: a line's customer, order and brand."""
    monkeypatch.setattr(fixtures, "DEALT", 40)
    folder = small_tables(spark, tmp_path)
    plan = plan_of(fixtures.halves(spark, folder))
    assert "ENSURE_REQUIREMENTS" not in plan and "SortMergeJoin" not in plan
    assert re.search(r"hashpartitioning\(l_partkey#\d+L?, 25\), REPARTITION_BY_NUM", plan) and re.search(r"hashpartitioning\(snapshot_date#\d+, ent#\d+L?, 25\)", plan)
    assert {(r["entity_slug"], r["total_n"]) for r in fixtures.halves(spark, folder).collect()} == {(f"c{i}", 58 if i == 0 else 57) for i in range(7)}
    trend = QUERIES["trend_rows"](spark, folder)
    joins = plan_of(trend).split("SortMergeJoin", 1)[1]
    assert re.search(r"hashpartitioning\(entity_slug#\d+, tag_slug#\d+, (\d+)\), REPARTITION_BY_NUM", joins)
    assert trend.count() == fixtures.halves(spark, folder).count()


def test_folders_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Shards of few bytes, but many folders, are written by several tasks."""
    monkeypatch.setattr(sh, "FOLDERS", 5)
    rows = spark.range(200).selectExpr("'s' || (id % 40) entity_slug", "'t' || id tag_slug", "id tag_n")
    for layout in ("json", "parquet"):
        sh.write_shards(sh.sharded(rows, "entity_slug"), f"{tmp_path}/{layout}", sh.entity_order(rows), layout=layout)
        back = sh.read_shards(spark, f"{tmp_path}/{layout}", "entity_slug string, tag_n bigint", layout=layout)
        assert len(tasks_of(back.inputFiles())) > 4
        assert back.selectExpr("sum(tag_n)").first()[0] == 199 * 100 and back.where("shard <> entity_slug").isEmpty()
    out = QUERIES["wrapped_scan"](spark, small_tables(spark, tmp_path))
    assert len(tasks_of(out.inputFiles())) > 4 and out.count() == 40


def test_the_guard_reads_pages_that_are_stored(spark, tmp_path, monkeypatch):
    """All four runs read the same stored pages; they are not made anew from the line items."""
    files, read = [], dm.read_payloads
    monkeypatch.setattr(dm, "read_payloads", lambda pages: files.extend(pages.inputFiles()) or read(pages))
    QUERIES["zero_rows_guard"](spark, small_tables(spark, tmp_path))
    assert files and not any("lineitem" in f for f in files)
