"""Registered queries beside their SQL at the smallest scale; check.py runs all of them."""

import os

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
NAMES = ["global_leaderboard", "affinity_ranks", "clean_keep_first", "trend_rows", "index_report", "payload_rows", "name_match", "set_index", "tiers_by_theme", "leaderboard_pages"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    difference, rows, _ = check.compare(spark, check.connect(FOLDER), FOLDER, name)
    assert difference is None and rows > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["entity_name", "entity_slug"]
