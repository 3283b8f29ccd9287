"""Exact k-means of integer vectors over a vector-approximation file.

Each vector is kept twice: whole, in buckets by its row number, and as an approximation of one cell of few bits in each dimension. For a centroid, a table
for each dimension says how near and how far the vectors of a cell can be; their sums over the dimensions are an interval that the vector's distance
lies in. What counts is which centroid is nearest, so the tables hold the squared distance less that from the middle of all centroids, which is the
same for each of them: this is linear in the vector, and its intervals are much narrower. A round reads the approximations only. A vector whose nearest interval lies below all others is assigned; only where intervals overlap,
or where a vector has moved and must leave one sum and enter another, is the whole vector fetched, by a join with the buckets that
moves the open rows alone. Distances, sums and means are whole numbers, so the result does not depend on the order of rows or on the cells.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from affinis.llm.batches import map_rows
from affinis.session import bucketed, materialise

#: Bits of a cell, and the accuracy of the quantiles that part cells.
BITS, ACCURACY = 8, 2000
#: Whole numbers beyond this would give squared distances beyond a long; such vectors take no part.
LARGEST = 1 << 27


def whole(rows: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(row, id, v) of the vectors that take part, in buckets by row."""
    x = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dimensions))
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale)))
    rows = rows.select("id", F.transform("x", lambda c: F.floor(scale * c).cast("int")).alias("v"))
    return bucketed(materialise(rows.withColumn("row", F.monotonically_increasing_id())), ["row"])


class Grid:
    """Cells of each dimension: cuts at quantiles over all vectors, and the least and greatest number."""

    def __init__(self, vectors: DataFrame, dimensions: int):
        shares = F.array(*[F.lit(i / (1 << BITS)) for i in range(1, 1 << BITS)])
        v = [F.col("v")[i] for i in range(dimensions)]
        found = vectors.agg(F.array(*[F.percentile_approx(c, shares, ACCURACY) for c in v]), F.array(*map(F.min, v)), F.array(*map(F.max, v))).first()
        self.cuts = np.array(found[0], dtype=np.int64)
        self.low = np.concatenate([np.array(found[1], dtype=np.int64)[:, None], self.cuts], axis=1)
        self.high = np.concatenate([self.cuts - 1, np.array(found[2], dtype=np.int64)[:, None]], axis=1)

    def cells(self, v: np.ndarray) -> np.ndarray:
        """A byte for each dimension."""
        return np.stack([np.searchsorted(cuts, v[:, i], side="right") for i, cuts in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[dimension][cell][centroid]: the least and the greatest squared distance, less that from the middle of the centroids."""
        middle = centroids.mean(axis=0).astype(np.int64)[:, None, None]
        c = centroids.T[:, None, :]
        ends = [c ** 2 - middle ** 2 - 2 * (c - middle) * end[:, :, None] for end in (self.low, self.high)]
        return np.minimum(*ends), np.maximum(*ends)


def overlapping(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row and centroid, whether the centroid may be the nearest: its interval begins no later than the first interval ends."""
    low = np.zeros((len(cells), tables[0].shape[2]), dtype=np.int64)
    high = low.copy()
    for i in range(cells.shape[1]):
        low += tables[0][i][cells[:, i]]
        high += tables[1][i][cells[:, i]]
    return low <= high.min(axis=1)[:, None]


def nearest(v: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of whole vectors among the centroids that are open to each, the smaller number on ties."""
    distance = np.full(open_.shape, np.iinfo(np.int64).max)
    for c, centroid in enumerate(centroids):
        at = np.flatnonzero(open_[:, c])
        distance[at, c] = ((v[at] - centroid) ** 2).sum(axis=1)
    best = distance.argmin(axis=1)
    return best.astype(np.int32), distance[np.arange(len(v)), best]


def bytes_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def numbers_of(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


class Clustering:
    """Rounds of assignment and means. `centroids` are the last ones, `fetched` says how many whole vectors each round called for."""

    def __init__(self, rows: DataFrame, k: int, rounds: int, id_col: str, vector_col: str, dimensions: int, scale: int, seed: int):
        self.spark, self.dimensions = rows.sparkSession, dimensions
        self.vectors = whole(rows, id_col, vector_col, dimensions, scale)
        start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
        self.centroids = np.array([r["v"] for r in self.vectors.orderBy(start, "v").limit(k).select("v").collect()], dtype=np.int64).reshape(-1, dimensions)
        self.fetched: list[int] = []
        if not len(self.centroids):
            return
        self.grid = Grid(self.vectors, dimensions)
        self.sums, self.counts = np.zeros_like(self.centroids), np.zeros(len(self.centroids), dtype=np.int64)
        state = materialise(self.approximations())
        for _ in range(rounds):
            state = materialise(self.assigned(state))
            if not self.moved(state):
                break

    def approximations(self) -> DataFrame:
        """(row, cells, cluster): the approximation file, nothing assigned yet."""
        grid, width = self.grid, self.dimensions

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            cells = grid.cells(numbers_of(batch["v"], width))
            return pa.RecordBatch.from_arrays([batch["row"], pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(np.full(len(cells), -1, dtype=np.int32))], ["row", "cells", "cluster"])

        return map_rows(self.vectors.select("row", "v"), run, "row long, cells binary, cluster int")

    def assigned(self, state: DataFrame) -> DataFrame:
        """(row, cells, was, cluster, v): every row assigned again, with its whole vector if it has moved."""
        centroids, width = self.centroids, self.dimensions
        tables = self.grid.tables(centroids)

        def bounds(batch: pa.RecordBatch) -> pa.RecordBatch:
            open_ = overlapping(bytes_of(batch["cells"], width), tables)
            cluster = np.where(open_.sum(axis=1) == 1, open_.argmax(axis=1), -1).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch["row"], batch["cells"], batch["cluster"], pa.array(cluster)], ["row", "cells", "was", "cluster"])

        def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
            cluster, _ = nearest(numbers_of(batch["v"], width), overlapping(bytes_of(batch["cells"], width), tables), centroids)
            moved = pa.array(cluster != np.asarray(batch["was"]))
            v = pc.if_else(moved, batch["v"], pa.scalar(None, batch["v"].type))
            return pa.RecordBatch.from_arrays([batch["row"], batch["cells"], batch["was"], pa.array(cluster), v], ["row", "cells", "was", "cluster", "v"])

        judged = map_rows(state.select("row", "cells", "cluster"), bounds, "row long, cells binary, was int, cluster int")
        settled = (F.col("cluster") >= 0) & (F.col("cluster") == F.col("was"))
        fetched = judged.where(~settled).hint("shuffle_hash").join(self.vectors.select("row", "v"), "row").select("row", "cells", "was", "v")
        schema = "row long, cells binary, was int, cluster int, v array<int>"
        return judged.where(settled).withColumn("v", F.lit(None).cast("array<int>")).unionByName(map_rows(fetched, exact, schema))

    def moved(self, state: DataFrame) -> bool:
        """Carry the moved rows from sum to sum and set the centroids; False if none moved. What comes back is one row for each centroid."""
        k, width = len(self.centroids), self.dimensions

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            v, was, cluster = numbers_of(batch["v"], width), np.asarray(batch["was"]), np.asarray(batch["cluster"])
            sums = np.stack([v[cluster == c].sum(axis=0) - v[was == c].sum(axis=0) for c in range(k)])
            counts = np.bincount(cluster, minlength=k) - np.bincount(was[was >= 0], minlength=k)
            return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts, pa.int64()), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array([len(v)] + [0] * (k - 1), pa.int64())], ["c", "n", "sums", "moved"])

        each = map_rows(state.where("v IS NOT NULL").select("v", "was", "cluster"), run, "c int, n long, sums array<long>, moved long")
        found = each.groupBy("c").agg(F.sum("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]), F.sum("moved")).collect()
        for c, n, sums, _ in found:
            self.counts[c] += n
            self.sums[c] += np.array(sums, dtype=np.int64)
        some = self.counts > 0
        self.centroids = self.centroids.copy()
        self.centroids[some] = self.sums[some] // self.counts[some, None]
        self.fetched.append(sum(r[3] for r in found))
        return bool(self.fetched[-1])

    def rows(self) -> DataFrame:
        """(id, cluster, distance) for every vector, assigned to the last centroids; one pass over the whole vectors, as each has its distance taken."""
        if not len(self.centroids):
            return self.vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        grid, centroids, width = self.grid, self.centroids, self.dimensions
        tables = grid.tables(centroids)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = numbers_of(batch["v"], width)
            cluster, distance = nearest(v, overlapping(grid.cells(v), tables), centroids)
            return pa.RecordBatch.from_arrays([batch["id"], pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

        return map_rows(self.vectors.select("id", "v"), run, f"id {self.vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def clustered(rows: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """One row for each vector that takes part: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector takes part if it has exactly `dimensions` components, all finite and below 2 ** 27 / scale, so that squared distances fit a long; each component x becomes
    floor(scale * x). The first centroids are the vectors with the smallest SHA-256 of `seed:id` (a null id as the empty text; equal hashes in order of the vector); fewer
    vectors than k give fewer. Ids may repeat or be null; other columns are not read. Empty tables, and tables without such vectors, give no rows.
    """
    made = Clustering(rows, k, rounds, id_col, vector_col, dimensions, scale, seed)
    found = materialise(made.rows())
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # one row for each centroid
    total = None if None in sums.values() else sum(sums.values())
    about = [(c, s, total if total is not None and total < 1 << 63 else None, hashlib.sha256(",".join(map(str, made.centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    named = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The same in DuckDB, round by round, without approximations."""
    apart = "list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.rid, min({{'d': {apart}, 'c': q.c}}) AS best FROM kept p CROSS JOIN c{i} q GROUP BY p.rid)")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v
    FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN kept USING (rid)) GROUP BY c, i)
    GROUP BY c) m USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE) AND abs(x::DOUBLE) < {LARGEST // 1024})) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, v LIMIT {k})),
{', '.join(steps)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(q.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} q ON q.c = best.c"""


#: The same for the table of embeddings in DuckDB.
SQL = _sql()
