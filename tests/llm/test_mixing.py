import hashlib

import numpy as np
from affinis.llm import mixing
from helpers import ODD_TEXTS, empty, frame
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def cube(spark, n):
    return spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k])) for i in range(3) for j in range(2) for k in range(4)], "source string, lang string, topic string, tokens long")


def test_weights_are_those_of_raking_by_hand(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GAP", -1.0)  # all passes
    rng = np.random.default_rng(20)
    n = rng.integers(1, 1000, (3, 2, 4)).astype(float)
    targets = [np.array([0.2, 0.3, 0.5]), np.array([0.6, 0.4]), np.array([0.1, 0.2, 0.3, 0.4])]
    frames = {m: spark.createDataFrame([(f"{m[0]}{i}", float(s)) for i, s in enumerate(t)], f"{m} string, share double") for m, t in zip(mixing.MARGINS, targets)}
    w, total = n.copy(), n.sum()
    for _ in range(6):
        for axis, t in enumerate(targets):
            others = tuple(a for a in range(3) if a != axis)
            shape = [-1 if a == axis else 1 for a in range(3)]
            w = w * (t * total / w.sum(axis=others)).reshape(shape)
    rows = mixing.raked(cube(spark, n), frames, 0.2, 6).collect()
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in rows}
    assert all(abs(got[f"s{i}", f"l{j}", f"t{k}"] - w[i, j, k]) < 1e-6 * w[i, j, k] for i in range(3) for j in range(2) for k in range(4))
    for axis, t in enumerate(targets):
        assert np.allclose(w.sum(axis=tuple(a for a in range(3) if a != axis)) / total, t, atol=1e-3)


def test_cut_cells_are_made_up_for(spark):
    """A cell with far fewer tokens than its share gives all it has; the margins are met all the same, and passes end when they are."""
    n = np.full((3, 2, 4), 1000.0)
    n[0, 0, :] = 40
    even = {m: spark.createDataFrame([(f"{m[0]}{i}", 1 / k) for i in range(k)], f"{m} string, share double") for m, k in zip(mixing.MARGINS, (3, 2, 4))}
    rows = mixing.raked(cube(spark, n), even, 0.5).collect()
    e = np.zeros_like(n)
    for r in rows:
        e[int(r["source"][1]), int(r["lang"][1]), int(r["topic"][1])] = r["expected"]
        assert r["expected"] <= r["tokens"] + 1e-9
    goal = 0.5 * n.sum()
    assert e[0, 0].sum() > 159
    for axis, k in enumerate((3, 2, 4)):
        assert np.allclose(e.sum(axis=tuple(a for a in range(3) if a != axis)), goal / k, rtol=0.002)


def test_values_with_too_few_documents_give_all(spark):
    cells = spark.createDataFrame([("a", 10), ("b", 500), ("c", 490)], "source string, tokens long")
    shares = spark.createDataFrame([("a", 0.4), ("b", 0.3), ("c", 0.3)], "source string, share double")
    got = {r["source"]: r["target"] for r in mixing.reachable(cells, shares, "source", 600.0).collect()}
    assert abs(got["a"] - 10) < 1e-9 and abs(got["b"] - 295) < 0.1 and abs(got["c"] - 295) < 0.1
    assert mixing.reachable(cells.where("false"), shares, "source", 0.0).count() == 0


def test_drawn_shares_meet_their_targets_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mixed(docs).cache()
    assert rows.count() == docs.count() and rows.where("kept AND tokens = 0").count() == 0
    cells = rows.groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight"))
    total = rows.agg(F.sum("tokens")).first()[0]
    for margin in mixing.MARGINS:
        shares = mixing.own_shares(cells, margin)
        want = {r[margin]: (r["target"], r["share"]) for r in mixing.reachable(cells, shares, margin, mixing.BUDGET * total).collect()}
        got = rows.groupBy(margin).agg(F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("drawn"), F.sum("weight").alias("weight"), F.sum("tokens").alias("n")).collect()
        for r in got:
            target, share = want[r[margin]]
            assert abs(r["drawn"] - target) <= 0.02 * target + 1, (margin, r[margin], r["drawn"], target)
            assert abs(r["weight"] / total - share) <= 0.002
    kept = rows.where("kept").agg(F.sum("tokens")).first()[0]
    assert abs(kept / total - mixing.BUDGET) < 0.006


def test_places_are_those_of_the_hash(spark):
    docs = frame(spark, ["a"] * 40, ("source", "lang"))
    for r in mixing.described(docs).collect():
        assert r["place"] == int(hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest()[:8], 16) * mixing.BINS >> 32
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("t"), F.monotonically_increasing_id()))
    assert mixing.described(unnamed).select("place").distinct().count() > 30


def test_odd_rows(spark):
    docs = frame(spark, ODD_TEXTS, ("source", "lang", "weight", "rate", "tokens"))
    rows = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    assert len(rows) == len(ODD_TEXTS)
    for i in (0, 1, 2):
        assert (rows[i]["tokens"], rows[i]["weight"], rows[i]["rate"], rows[i]["kept"]) == (0, 0, 0, False)
    clash = frame(spark, ODD_TEXTS, ("source", "lang", "row", "d", "cell", "cut", "place", "cell_rate", "cell_source", "expected", "topic", "tokens"))
    drawn = mixing.sampled(clash)
    assert drawn.columns == clash.columns and drawn.where("text IS NULL OR trim(text) = ''").count() == 0 and set(map(tuple, drawn.collect())) <= set(map(tuple, clash.collect()))
    nulls = docs.withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.mixed(nulls).count() == len(ODD_TEXTS)
    none = empty(spark).withColumn("source", F.lit("a")).withColumn("lang", F.lit("b"))
    assert mixing.mixed(none).count() == 0 and mixing.sampled(none).count() == 0


def test_sample_is_what_the_report_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in mixing.mixed(docs).where("kept").collect()}
