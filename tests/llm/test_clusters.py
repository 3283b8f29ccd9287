import hashlib
import math

import numpy as np
import pytest

import check
from affinis.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, id string, row string, v string, cluster string, distance string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "i", "r", "v", "c", "d") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, k=8, rounds=10, dimensions=64):
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) in Python's own whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x) < 2 ** 17 for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assigned()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(kept, found) if at == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own)]
    found = assigned()
    inertia = [sum(d for d, at in found if at == j) for j in range(len(centroids))]
    return sorted((repr(i), j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found))


def got_of(df):
    return sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("bits", [2, 8])
def test_matches_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(clusters, "BITS", bits)
    rng = np.random.default_rng(bits)
    centres = rng.normal(size=(5, 64))
    vectors = [(int(i), (centres[i % 5] + rng.normal(size=64) * rng.choice([0.1, 1.0])).tolist()) for i in range(150)]
    assert got_of(clusters.clustered(frame(spark, vectors))) == brute(vectors)


def test_odd_rows_take_no_part_and_extremes_stay_exact(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] * 64
    odd = [(100, None), (101, []), (102, one[:63]), (103, one + [1.0]), (104, one[:63] + [None]), (105, one[:63] + [nan]), (106, one[:63] + [-inf]), (107, one[:63] + [1e300])]
    rng = np.random.default_rng(7)
    good = [(i, rng.normal(size=64).tolist()) for i in range(20)] + [(30, [131071.9] * 64), (31, [-131071.9] * 64), (None, one), (None, [0.0] * 64), (5, one), (5, one)]
    vectors = odd + good
    assert got_of(clusters.clustered(frame(spark, vectors))) == brute(vectors)


def test_ties_equal_vectors_and_few_rows(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    assert got_of(clusters.clustered(frame(spark, same))) == brute(same)
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (3, [0.5] * 64)]
    assert got_of(clusters.clustered(frame(spark, few))) == brute(few)


def test_empty_tables(spark):
    assert clusters.clustered(frame(spark, []).where("false")).count() == 0
    assert clusters.clustered(frame(spark, [(1, None), (2, [1.0])])).count() == 0


def test_intervals_hold_every_distance_and_spare_most_vectors(spark):
    rng = np.random.default_rng(3)
    centres = 4 * rng.normal(size=(8, 64))
    x = np.floor(1024 * (centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 64)))).astype(np.int64)
    grid = clusters.Grid(spark.createDataFrame([(v.tolist(),) for v in x], "v array<int>"), 64)
    centroids = np.floor(1024 * centres).astype(np.int64)
    open_ = clusters.overlapping(grid.cells(x), grid.tables(centroids))
    exact = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert open_[np.arange(len(x)), exact.argmin(axis=1)].all()
    assert (open_.sum(axis=1) == 1).mean() > 0.95


def test_only_open_rows_are_shuffled(spark):
    """The whole vectors are read where they lie: the one exchange of an assignment is that of the approximations' open rows."""
    rng = np.random.default_rng(4)
    vectors = [(int(i), rng.normal(size=64).tolist()) for i in range(200)]
    made = clusters.Clustering(frame(spark, vectors).select("vec_id", "embedding"), 8, 2, "vec_id", "embedding", 64, 1024, 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = made.assigned(clusters.materialise(made.approximations()))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_sql_gives_the_same_rows(spark):
    folder = "/root/testdata/sf0.001"
    assert check.compare(spark, check.connect(folder), folder, "op13_centroid_clustering")[0] is None
