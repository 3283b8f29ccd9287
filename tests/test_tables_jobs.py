import json

import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from affinis.config import AffinityConfig
from affinis.plans import jobs
from affinis.session import materialise, scratch, stored
from affinis.sinks import records as rc, shards as sh, versions as vs
from affinis.sources import records as rd, snapshots as ss
from affinis.sources.cards import card_columns, read_cards
from affinis.sources.identities import first_identities
from test_cleaning import SCHEMA as RAW, raw
from test_enrich import CARD, card

PAIR = "entity_slug string, tag_slug string, z double, n int"


def part_files(path):
    return sorted(p for p in path.rglob("part-*") if not p.name.endswith(".crc"))


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([("b", "t", 1.0, 1), ("a", "t", float("nan"), 2), ("a", "u", 3.0, 3), ("a b!", "u", None, 4)], PAIR)


def test_lines_skip_blanks_and_refuse_junk(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"entity_slug": "a", "n": 1}\n\n{"entity_slug": "b"}\n')
    bad.write_text('{"entity_slug": "a"}\n"text"\n')
    assert [r["entity_slug"] for r in rd.read_lines(spark, str(good), PAIR).collect()] == ["a", "b"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        rd.read_lines(spark, str(bad), PAIR).collect()


def test_wrapped_files_take_the_first_list(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"count": 2, "rows": [{"entity_slug": "r", "n": 1}], "data": [{"entity_slug": "d"}]}))
    assert [r["entity_slug"] for r in rd.read_records(spark, str(path), PAIR, layout="wrapped").collect()] == ["r"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        rd.read_records(spark, str(path), PAIR, layout="wrapped", keys=rd.SIGNAL_WRAPPER_KEYS).collect()


def test_a_wrapped_record_with_a_bad_field_fails(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"records": [{"entity_slug": "a", "n": 1}, {"entity_slug": "b", "n": "bad"}]}))
    with pytest.raises((PySparkException, Py4JJavaError)):
        rd.read_records(spark, str(path), PAIR, layout="wrapped").collect()


def test_copies_replace_their_tables_and_keep_or_clean_others(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rc.write_records(spark.range(2), f"{source}/t", layout="parquet")
    rc.write_records(spark.range(1), f"{target}/other", layout="parquet")
    for _ in range(2):
        rc.copy_tables(spark, source, target, ["t"], [], clean=False)
    assert spark.read.parquet(f"{target}/t").count() == 2 and rd.exists(spark, f"{target}/other")
    rc.copy_tables(spark, source, target, ["t"], [])
    assert spark.read.parquet(f"{target}/t").count() == 2 and not rd.exists(spark, f"{target}/other")


def test_missing_inputs(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"entity_slug": "a"}]')
    assert rd.read_records(spark, str(tmp_path / "x.jsonl"), PAIR).first()["entity_slug"] == "a"
    assert rd.read_status(spark, str(tmp_path / "none.jsonl"), PAIR).count() == 0
    with pytest.raises(FileNotFoundError):
        rd.read_records(spark, str(tmp_path / "none.jsonl"), PAIR)
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(ValueError, match="empty"):
        rd.read_facts(spark, str(tmp_path / "empty.jsonl"), PAIR, layout="lines")


def test_index_records_need_a_slug(spark, tmp_path):
    path = tmp_path / "i.json"
    path.write_text('[{"entity_slug": "a"}, {"n": 1}]')
    with pytest.raises((PySparkException, Py4JJavaError)):
        rd.read_index(spark, str(path), PAIR).collect()


def test_file_order_is_the_order_of_lines(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(json.dumps({"entity_slug": "x" * 50, "n": i}) + "\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = rd.with_file_order(rd.read_lines(spark, str(path), PAIR))
        assert df.rdd.getNumPartitions() > 4
        assert [r["n"] for r in df.orderBy("ordinal").collect()] == list(range(4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_json_sinks_write_nulls(spark, pairs, tmp_path):
    rc.write_records(pairs.coalesce(1), str(tmp_path / "l"))
    lines = [json.loads(x) for x in part_files(tmp_path / "l")[0].read_text().splitlines()]
    assert [x["z"] for x in lines] == [1.0, None, 3.0, None]
    rc.append_records(pairs, str(tmp_path / "l"))
    assert rd.read_lines(spark, str(tmp_path / "l"), PAIR).count() == 8
    rc.write_records(pairs.repartition(3), str(tmp_path / "a"), layout="array")
    found = [row for f in part_files(tmp_path / "a") for row in json.loads(f.read_text())]
    assert sorted(r["n"] for r in found) == [1, 2, 3, 4]
    rc.lines_to_arrays(spark, str(tmp_path / "l"), str(tmp_path / "b"), PAIR)
    assert rd.read_array(spark, str(tmp_path / "b"), PAIR).count() == 8


def test_shards_are_sorted_folders(spark, pairs, tmp_path):
    sh.write_shards(sh.sharded(pairs, "entity_slug"), str(tmp_path / "s"), sh.entity_order(pairs))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"shard=a", "shard=b", "shard=a-b"}
    rows = [json.loads(x)["n"] for f in part_files(tmp_path / "s" / "shard=a") for x in f.read_text().splitlines()]
    assert rows == [3, 2]
    sh.write_shards(sh.sharded(pairs, "entity_slug"), str(tmp_path / "c"), sh.entity_order(pairs), layout="clustered")
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4


def test_all_tables_of_an_empty_snapshot_are_replaced(spark, pairs, tmp_path):
    root = str(tmp_path / "snaps")
    for table in ("facts", "more"):
        ss.write_snapshot(pairs, f"{root}/{table}", "2026-05-07")
        ss.write_snapshot(pairs.limit(1), f"{root}/{table}", "2026-05-14")
    reports = spark.createDataFrame([("2026-05-14", "0"), ("latest", "0"), ("2026-05-07", "n/a")], "snapshot_date string, clean_tag_row_count string")
    with pytest.raises(FileNotFoundError):
        jobs.replace_empty_snapshot(spark, root, "2026-06-01", ["facts", "more"], reports)
    got = jobs.replace_empty_snapshot(spark, root, "latest", ["facts", "more"], reports, f"{root}/report").first()
    assert (got["fallback_snapshot"], got["fallback_row_count"]) == ("2026-05-07", 4)  # the report says that the one between is empty
    assert spark.read.parquet(f"{root}/report").first() == got
    assert all(ss.read_snapshot(spark, f"{root}/{t}", "latest").count() == 4 for t in ("facts", "more"))


def test_one_large_shard_becomes_several_files_in_order(spark, tmp_path):
    big = spark.range(6000).select(F.lit("hot").alias("entity_slug"), F.col("id").cast("string").alias("tag_slug"), F.rand(1).alias("z"), F.lit(1).alias("n"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sh.write_shards(sh.sharded(big, "entity_slug"), str(tmp_path / "h"), sh.entity_order(big))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = part_files(tmp_path / "h" / "shard=hot")
    scores = [json.loads(x)["z"] for f in files for x in f.read_text().splitlines()]
    assert len(files) > 1 and len(scores) == 6000 and scores == sorted(scores, reverse=True)


def test_lost_shards_are_found_in_the_files(spark, pairs, tmp_path):
    rows, path = sh.sharded(pairs, "entity_slug"), str(tmp_path / "s")
    sh.write_shards(rows, path, sh.entity_order(pairs))
    wanted = sh.shard_sizes(pairs, "entity_slug", "entities")
    assert sh.differing_shards(wanted, sh.stored_sizes(spark, path, "entities")).count() == 0
    assert [r["n"] for r in sh.read_shards(spark, f"{path}/shard=a", PAIR).collect()] == [3, 2]
    rd.remove(spark, f"{path}/shard=a")
    assert [(r["shard"], r["wanted_rows"], r["stored_rows"]) for r in sh.differing_shards(wanted, sh.stored_sizes(spark, path, "entities")).collect()] == [("a", 2, None)]
    with pytest.raises(ValueError):
        sh.write_shards(rows, path, sh.entity_order(pairs), layout="folders")


def test_missing_shards_are_found(spark, pairs):
    index = spark.createDataFrame([("a",), ("a b!",), ("zzz",)], "entity_slug string")
    sizes = sh.shard_sizes(pairs, "entity_slug", "entities")
    assert [r["shard"] for r in sh.missing_shards(index, "entity_slug", sizes, "entities").collect()] == ["zzz"]
    assert sh.shard_check([("entities", index, "entity_slug", sizes)]).first()[:] == ("entities", 3, 1)


def test_copy_tables(spark, pairs, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    rc.write_records(pairs, f"{src}/one", layout="parquet")
    with pytest.raises(FileNotFoundError, match="two"):
        rc.copy_tables(spark, src, dst, ["one", "two"], [])
    manifest = {r["table_name"]: r["copied"] for r in rc.copy_tables(spark, src, dst, ["one"], ["opt"]).collect()}
    assert manifest == {"one": True, "opt": False} and spark.read.parquet(f"{dst}/one").count() == 4


def failing(df):
    """Rows of which the last task cannot be written, after others have been."""
    late = F.when(F.spark_partition_id() == 3, F.raise_error(F.lit("disk is gone"))).otherwise(F.col("entity_slug"))
    return df.repartition(4, "entity_slug", "tag_slug").withColumn("entity_slug", late)


def test_a_failed_replacement_leaves_the_old_rows(spark, pairs, tmp_path):
    path = str(tmp_path / "table")
    rows = pairs.crossJoin(spark.range(50)).withColumn("entity_slug", F.concat("entity_slug", "id")).drop("id")
    rc.write_records(rows, path, layout="parquet")
    old = sorted(map(tuple, vs.read_table(spark, path).collect()))
    for again in range(2):  # as first written, then as a version
        with pytest.raises(Exception, match="disk is gone"):
            vs.replace_table(failing(vs.read_table(spark, path)), path)
        assert sorted(map(tuple, vs.read_table(spark, path).collect())) == old
        assert vs.replace_table(vs.read_table(spark, path), path) == {"rows": 200}
        assert sorted(map(tuple, vs.read_table(spark, path).collect())) == old
    assert [p.name for p in (tmp_path / "table").iterdir() if not p.name.startswith(".")] == ["_versions"]
    assert len(list((tmp_path / "table" / "_versions").glob("[0-9]*"))) == 2


def test_an_unfinished_version_is_not_read_and_goes(spark, pairs, tmp_path):
    path = str(tmp_path / "table")
    rc.write_records(pairs, path, layout="parquet")
    pairs.limit(1).write.parquet(f"{path}/_versions/000001-lost")  # written, never named
    assert vs.read_table(spark, path).count() == 4
    (tmp_path / "table" / "_versions" / "000002.current").write_text("")  # a pointer cut short
    assert vs.read_table(spark, path).count() == 4
    assert vs.replace_table(pairs.limit(2), path) == {"rows": 2} and vs.read_table(spark, path).count() == 2
    assert len(list((tmp_path / "table" / "_versions").glob("[0-9]*"))) == 2
    with pytest.raises(Exception, match="exist"):
        vs.put_text(spark, vs.current_path(spark, path).rsplit("-", 1)[0] + ".current", "twice")


def test_enrichment_counts_while_writing_and_survives_a_failure(spark, pairs, tmp_path):
    root = str(tmp_path)
    rc.write_records(pairs, f"{root}/rows", layout="parquet")
    old = sorted(map(tuple, vs.read_table(spark, f"{root}/rows").collect()))
    metadata = pairs.select("entity_slug").distinct().withColumn("card_image_url", F.lit("x"))
    bad = metadata.withColumn("card_image_url", F.when(F.col("entity_slug") == "b", F.raise_error(F.lit("disk is gone"))).otherwise("y"))
    with pytest.raises(Exception, match="disk is gone"):
        rc.enrich_tables(spark, root, ["rows"], bad)
    assert sorted(map(tuple, vs.read_table(spark, f"{root}/rows").collect())) == old
    assert rc.enrich_tables(spark, root, ["rows", "absent"], metadata) == {"rows": 4}
    assert vs.read_table(spark, f"{root}/rows").where("card_image_url = 'x'").count() == 4


def test_a_failed_copy_changes_nothing(spark, pairs, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    for name in ("one", "two"):
        rc.write_records(pairs, f"{src}/{name}", layout="parquet")
        rc.write_records(pairs.limit(1), f"{dst}/{name}", layout="parquet")
    next((tmp_path / "src" / "two").glob("part-*")).write_bytes(b"broken")
    with pytest.raises(Exception):
        rc.copy_tables(spark, src, dst, ["one", "two"], [])
    assert spark.read.parquet(f"{dst}/one").count() == spark.read.parquet(f"{dst}/two").count() == 1
    rc.write_records(pairs, f"{src}/two", layout="parquet")
    rc.copy_tables(spark, src, dst, ["one", "two"], [])
    assert spark.read.parquet(f"{dst}/two").count() == 4 and not (tmp_path / "dst" / "_incoming").exists()


def test_figures_of_empty_rows(spark, pairs):
    rows, seen = stored(pairs.where("false"), {"n": F.count(F.lit(1)), "s": F.sum("n")})
    assert rows.count() == 0 and seen == {"n": 0, "s": None}


def test_snapshots_and_fallback(spark, pairs, tmp_path):
    root = str(tmp_path / "snap")
    ss.write_snapshot(pairs, root, "2026-05-07")
    ss.write_snapshot(pairs.limit(1), root, "2026-05-14")
    ss.write_snapshot(pairs.limit(1), root, "2026-05-14")
    assert ss.read_snapshot(spark, root, "2026-05-14").count() == 1 and ss.read_snapshot(spark, root, "2026-05-07").count() == 4
    report = jobs.replace_empty_snapshot(spark, root, "2026-05-21").first()
    assert (report["fallback_used"], report["fallback_snapshot"]) == (True, "2026-05-14")
    assert ss.read_snapshot(spark, root, "2026-05-21").count() == 1
    assert not jobs.replace_empty_snapshot(spark, root, "2026-05-21").first()["fallback_used"]
    with pytest.raises(RuntimeError):
        jobs.replace_empty_snapshot(spark, root, "2020-01-01")
    plan = ss.read_snapshot(spark, root, "2026-05-14", check=False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_best_source_of_identities(spark, pairs):
    rows = pairs.withColumn("entity_name", F.upper("entity_slug"))
    got = first_identities([None, rows.limit(0), rows], [[], ["n"], ["n"]])
    assert [r["entity_name"] for r in got.collect()] == ["A", "A B!", "B"]
    with pytest.raises(FileNotFoundError):
        first_identities([None], [[]])


def test_whole_batch(spark, tmp_path):
    """Raw rows to published shards, through every run."""
    root, snaps, site = (str(tmp_path / n) for n in ("work", "snaps", "site"))
    slugs = ("alpha", "beta", "gamma")
    index = spark.createDataFrame([(s,) for s in slugs], "entity_slug string")
    normal = [raw(i * 10 + j, s, "1000", t, str(100 * (i + 1) + j)) for i, s in enumerate(slugs) for j, t in enumerate(("tokens", "aggro"))]
    signal = [raw(i, s, "1000", "x", str(10 * (i + 1)), "cedh_filtered_json") for i, s in enumerate(slugs)]
    frame = lambda rows: spark.createDataFrame(rows, RAW)
    report = jobs.run_cleaning(index, [("normal", frame(normal + [raw(99, "who")]), ["row"]), ("signal", frame(signal), ["row"])], root).first()
    assert (report["clean_tag_row_count"], report["invalid_row_count"], report["cedh_clean_row_count"]) == (9, 1, 3)

    counts = {(r["kind"], r["value"]): r["row_count"] for r in spark.read.parquet(f"{root}/validation_counts").collect()}
    assert counts["input", "normal"] == 7 and counts["input", "signal"] == 3 and counts["source_type", "cedh_filtered_json"] == 3 and counts["reason", ""] == 9

    affinity = jobs.run_analysis(spark.read.parquet(f"{root}/tags_clean"), root, AffinityConfig())
    assert affinity.count() == 9 and spark.read.parquet(f"{root}/analysis_summary").first()["unique_tag_count"] == 3
    ss.write_snapshot(affinity, snaps, "2026-05-07")
    ss.write_snapshot(affinity.where("entity_slug <> 'beta'"), snaps, "2026-05-14")
    first = jobs.run_trends(spark, snaps, "2026-05-07", f"{root}/first")
    assert {r[0] for r in first.select("snapshot_status").distinct().collect()} == {"no_previous_snapshot"}
    jobs.run_trends(spark, snaps, "2026-05-14", root)
    assert spark.read.parquet(f"{root}/trend_summary").first()["removed_pair_count"] == 3

    cards = spark.createDataFrame([card(1, "Alpha", "W", "pic"), card(2, "Gamma", "U", "pic", code="khm")], CARD)
    entities = spark.read.parquet(f"{root}/entities").select("entity_slug", "entity_name")
    jobs.run_enrichment(spark, entities, cards, None, ["row"], root, ["affinity_rows_with_trends", "absent"])
    rows = vs.read_table(spark, f"{root}/affinity_rows_with_trends")
    assert {r["match_strategy"] for r in rows.select("match_strategy").collect()} == {"exact_full_name"}
    assert spark.read.parquet(f"{root}/enrichment_summary").first()["unmatched_count"] == 1

    manifest = jobs.run_publish(rows, spark.read.parquet(f"{root}/tag_summary"), site, AffinityConfig(page_size=4), summaries=root).first()
    assert (manifest["total_rows"], manifest["unique_entities"], manifest["unique_tags"]) == (6, 2, 3)
    assert {f["family"]: f["shard_count"] for f in manifest["families"]} == {"entities": 2, "sets": 2, "tags": 3, "theme-brackets": 2}
    pages = spark.read.parquet(f"{site}/leaderboard_index").orderBy("page").collect()
    assert [(p["page"], p["row_count"]) for p in pages] == [(1, 4), (2, 2)]
    assert sorted(p.name for p in (tmp_path / "site" / "leaderboard").iterdir() if p.is_dir()) == ["page=1", "page=2"]
    assert spark.read.parquet(f"{site}/theme_brackets_index").count() == 3
    assert spark.read.parquet(f"{site}/sets_index").count() == 2
    assert spark.read.parquet(f"{site}/summaries/trend_summary").count() == 1
    assert (manifest["layout"], manifest["page_size"], manifest["page_count"], manifest["leaderboard_rows"]) == ("json", 4, 2, 6)
    for name in ("leaderboard_index", "sets_index", "theme_brackets_index"):
        for entry in spark.read.parquet(f"{site}/{name}").collect():
            assert rd.exists(spark, f"{site}/{entry['file']}") or entry["qualified_entity_count"] == 0
    tables = jobs.run_publish(rows, None, f"{site}-tables", AffinityConfig(page_size=4), layout="clustered").first()
    assert tables["layout"] == "clustered" and spark.read.parquet(f"{site}-tables/entities").count() == 6


def test_scratch_tables_are_removed(spark):
    with scratch(spark):
        kept = materialise(spark.range(3))
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert rd.exists(spark, path)
    assert not rd.exists(spark, path)


def test_bulk_cards(spark, tmp_path):
    path = tmp_path / "bulk.jsonl"
    path.write_text(json.dumps({"name": "Ann", "id": "1", "set": "khm", "page": "https://c/1", "color_identity": ["G"], "image_uris": {"normal": "n"}, "extra": 1}) + "\n")
    got = read_cards(spark, str(path), "page", "set_page").first()
    assert (got["card_name"], got["set_code"], got["card_uri"], got["image_uris"]["normal"], got["set_page_uri"]) == ("Ann", "khm", "https://c/1", "n", None)
    assert card_columns(spark.createDataFrame([("Bob",)], "name string"), "page", "set_page").first()["card_id"] is None
