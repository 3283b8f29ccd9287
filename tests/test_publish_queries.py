"""Published files read back whole: each query beside its SQL, and faults in any shard show."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from affinis.sinks import shards as sh
from catalog.publish_queries import PLAIN, stored_rows

FOLDER = "/root/testdata/sf0.001"
NAMES = ["shard_family_rows", "page_files", "summaries_copied", "zero_rows_guard"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    assert name in entry.oracle_sql()
    difference, rows, _ = check.compare(spark, check.connect(FOLDER), FOLDER, name)
    assert difference is None and rows > 0


def test_places_of_all_shards_come_from_the_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i}", f"t{i % 7}", i) for i in range(70)], PLAIN)
    sh.write_shards(sh.sharded(rows, "tag_slug"), f"{tmp_path}/tags", [F.col("tag_n").desc()])
    index = spark.createDataFrame([(f"tags/shard=t{i}",) for i in range(6)], "file string")
    got = {(r["file"], r["tag_n"]): r["place"] for r in stored_rows(spark, str(tmp_path), "tags", PLAIN, index).collect()}
    assert got == {(f"tags/shard=t{i % 7}", i): 9 - i // 7 for i in range(70) if i % 7 < 6}


def test_very_many_folders_are_read_in_groups(spark, tmp_path, monkeypatch):
    """The driver never holds the files of more than LISTED folders, and the rows, places and sizes are those of one scan."""
    rows = spark.createDataFrame([(f"e{i}", f"t{i % 10}", i) for i in range(70)], PLAIN)
    index = spark.createDataFrame([(f"tags/shard=t{i}",) for i in range(9)] + [("tags/shard=none",)], "file string")
    wanted = sh.shard_sizes(rows, "tag_slug", "tags")
    read = []

    def watched(*args, made=sh.read_shards, **options):
        read.append(made(*args, **options))
        return read[-1]

    monkeypatch.setattr(sh, "read_shards", watched)
    for layout in ("json", "parquet"):
        sh.write_shards(sh.sharded(rows, "tag_slug"), f"{tmp_path}/{layout}/tags", [F.col("tag_n").desc()], layout=layout)
    tags = f"{tmp_path}/json/tags"
    whole = sorted(stored_rows(spark, f"{tmp_path}/json", "tags", PLAIN, index).drop("ordinal").collect())
    monkeypatch.setattr(sh, "LISTED", 3)
    read.clear()
    got = stored_rows(spark, f"{tmp_path}/json", "tags", PLAIN, index)
    assert [len({os.path.dirname(f) for f in r.inputFiles()}) for r in read] == [3, 3, 3, 1]
    assert not any(tags in f for f in got.inputFiles())  # its plan holds none of the files
    assert sorted(got.drop("ordinal").collect()) == whole and len(whole) == 63
    assert {(r["file"], r["tag_n"]): r["place"] for r in got.collect()} == {(f"tags/shard=t{i % 10}", i): 6 - i // 10 for i in range(70) if i % 10 < 9}
    for layout in ("json", "parquet"):
        assert sh.differing_shards(wanted, sh.stored_sizes(spark, f"{tmp_path}/{layout}/tags", "tags", layout=layout)).isEmpty()
    os.rename(f"{tags}/shard=t4", f"{tags}/shard=t40")
    faults = sh.differing_shards(wanted, sh.stored_sizes(spark, tags, "tags")).collect()
    assert {(r["shard"], r["wanted_rows"], r["stored_rows"]) for r in faults} == {("t4", 7, None), ("t40", None, 7)}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "65536" and spark.conf.get("spark.sql.hive.filesourcePartitionFileCacheSize", None) is None


def test_names_of_shard_folders(spark, tmp_path, monkeypatch):
    names = ["a", "b,c", "d, e", "f=g", "h%i"]
    spark.createDataFrame([(n, i) for i, n in enumerate(names)], "shard string, tag_n bigint").write.partitionBy("shard").json(f"{tmp_path}/x")
    monkeypatch.setattr(sh, "LISTED", 2)
    folders = sh.shard_folders(spark, f"{tmp_path}/x")
    assert folders == sorted(n for n in os.listdir(tmp_path / "x") if n.startswith("shard=")) and len(folders) == 5
    assert {(r["shard"], r["row_count"]) for r in sh.stored_sizes(spark, f"{tmp_path}/x", "x").collect()} == {(n, 1) for n in names}
    assert sh.shard_folders(spark, f"{tmp_path}/none") == []


def test_bounds_of_very_many_tasks_come_from_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sh, "FOLDERS", 5)
    monkeypatch.setattr(sh, "SAMPLED", 16)
    used, settings = [], sh.settings
    monkeypatch.setattr(sh, "settings", lambda session, values: used.append(values) or settings(session, values))
    rows = spark.range(400).selectExpr("'s' || (id % 40) entity_slug", "'t' || id tag_slug", "id tag_n")
    sh.write_shards(sh.sharded(rows, "entity_slug"), f"{tmp_path}/s", sh.entity_order(rows))
    assert used == [{"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2"}]
    assert spark.conf.get("spark.sql.execution.rangeExchange.sampleSizePerPartition", None) is None
    assert sh.differing_shards(sh.shard_sizes(rows, "entity_slug", "s"), sh.stored_sizes(spark, f"{tmp_path}/s", "s")).isEmpty()
    assert sh.read_shards(spark, f"{tmp_path}/s", "tag_n bigint").selectExpr("sum(tag_n)").first()[0] == 200 * 399
