import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from affinis.operators.paging import page_index, with_page, with_position
from affinis.operators.ranking import value_ranks, value_slot, window_ranks


def sample(n=4000, seed=3):
    rnd = random.Random(seed)
    hot = lambda: "hot" if rnd.random() < 0.5 else f"g{rnd.randrange(40)}"
    draw = lambda: rnd.choice([None, 0.0, rnd.uniform(-3, 3), round(rnd.uniform(-1, 1), 2), float(rnd.randrange(5)), rnd.random() * 1e-9])
    return pd.DataFrame({"g": [hot() for _ in range(n)], "v": [draw() for _ in range(n)]})


def test_slots_never_fall_as_values_grow(spark):
    values = sorted({x for x in sample().v.dropna()} | {1e300, -1e300, 5e-324, -5e-324, 1e15, 123456789.0})
    slots = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(value_slot("v")).collect()]
    assert slots == sorted(slots)


@pytest.mark.parametrize("partitions", [1, 7])
def test_ranks_match_pandas_and_windows(spark, partitions):
    data = sample()
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), "g string, v double").repartition(partitions)
    by_group = data.groupby("g").v
    want = data.assign(rank_desc=by_group.rank(method="min", ascending=False), pct=by_group.rank(method="average", pct=True)).dropna().drop_duplicates()
    want = {(r.g, r.v): (int(r.rank_desc), round(r.pct, 9)) for r in want.itertuples()}
    for ranks in (value_ranks, window_ranks):
        got = {(r["g"], r["v"]): (r["rank_desc"], round(r["rank_asc"] / r["n_group"], 9)) for r in ranks(df, "g", "v").collect()}
        assert got == want


def test_positions_follow_the_order(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice([None, 1.0, 2.0, rnd.random()])) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, z double").repartition(6)
    placed = with_position(df, [F.col("z").desc_nulls_last(), F.col("id").asc()], partitions=5)
    got = [r["id"] for r in placed.orderBy("position").collect()]
    want = [i for i, _ in sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert got == want
    assert sorted(r["position"] for r in placed.collect()) == list(range(3000))


def test_pages(spark, rows):
    df = spark.range(1201).withColumn("position", F.col("id"))
    index = {r["page"]: r for r in rows(page_index(with_page(df, 500), 500))}
    assert [(index[p]["start_row"], index[p]["end_row"], index[p]["row_count"]) for p in (1, 2, 3)] == [(0, 500, 500), (500, 1000, 500), (1000, 1201, 201)]
    assert index[3]["file"] == "leaderboard/page=3"
    assert page_index(with_page(df, 0), 0).count() == 0
