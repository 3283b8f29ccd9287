"""Time the headline queries: one JSON line. Folder from BENCH_SF_DIR, cores from BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

from affinis.session import local_session, scratch
from catalog import QUERIES

HEADLINE = [
    "global_leaderboard", "affinity_ranks", "tag_summary", "clean_rows", "validation_report", "trend_rows", "affinity_with_trends",
    "payload_rows", "signal_status", "card_metadata", "enriched_rows", "set_rows", "tiers_by_set", "tiers_by_theme", "explore_leaderboard",
    "entity_rollup", "leaderboard_pages", "sink_round_trip", "name_match", "stored_shard_check",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["global_leaderboard"](spark, folder).write.format("noop").mode("overwrite").save()  # the first query of a session pays for its start
    took = {}
    for name in names:
        with scratch(spark):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
