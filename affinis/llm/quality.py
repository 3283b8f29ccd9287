"""Quality of documents: a regularised quadratic discriminant over transformed text statistics.

Each class is a Gaussian with its own mean and a covariance shrunk towards its diagonal. What a class needs is its number of
rows, sums and sums of products, which Spark adds up over every learning row; no row reaches the driver. Scores come from the
difference of the two log densities, by triangular solves with Cholesky factors made once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from affinis.llm.batches import map_rows, texts_of
from affinis.session import materialise

#: Share of the diagonal in a class covariance, least variance of a statistic, and the score from which a text is good.
SHRINKAGE, LEAST, THRESHOLD = 0.1, 1e-4, 0.7

STATISTICS = (
    "words", "word_length", "word_spread", "upper", "signs", "digits", "marks", "pipes", "distinct", "repeats", "line_words", "ends",
)


def statistics(text: str) -> list[float]:
    """Numbers that describe a text as a whole, each on a scale on which good texts are roughly normal."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    letters = upper + lower + int(counts[192:].sum())  # one leading byte for each letter outside ASCII
    sentence, space = int(counts[[33, 44, 46, 63]].sum()), int(counts[[9, 10, 13, 32]].sum())
    signs = int(counts[33:127].sum()) - upper - lower - digits - sentence
    n, sizes = len(words), np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    chars = max(1, len(text) - space)
    return [
        math.log1p(n), math.log(sizes.mean()), math.log1p(sizes.std()), math.sqrt(upper / max(1, letters)), math.sqrt(max(0, signs) / chars),
        math.sqrt(digits / chars), math.sqrt(int(counts[33]) / n), math.sqrt(int(counts[124]) / n), math.log(len(set(words))) / max(1.0, math.log(n)),
        math.sqrt(sum(map(eq, words, words[1:])) / n), math.log(n / (1 + int(counts[10]))), math.sqrt(sentence / n),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) for every row: the statistics of its whole text, an array of doubles. A null text counts as empty."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch[0], pa.array([statistics(t) for t in texts_of(batch, "text")], type=pa.list_(pa.float64()))], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, f"id {kind}, x array<double>", "text").withColumnRenamed("id", id_col)


@dataclass
class Discriminant:
    """Two Gaussians. Without rows of both labels `prior` alone is the score: 1 where nothing is known against any text."""

    prior: float
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        if self.means is None:
            return np.full(len(x), self.prior)
        logs = []
        for mean, factor in zip(self.means, self.factors):
            apart = np.linalg.solve(factor, (x - mean).T)  # the factor is triangular: a Mahalanobis distance without an inverse
            logs.append(-0.5 * (apart ** 2).sum(axis=0) - np.log(np.diag(factor)).sum())
        gap = logs[1] - logs[0] + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fitted(rows: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From (x, label, weight) with label 0 or 1: sums by class over all rows, brought together as two rows of numbers."""
    k = len(STATISTICS)
    x = [F.col("x")[i] for i in range(k)]
    sums = [F.sum(F.col("weight") * x[i]) for i in range(k)] + [F.sum(F.col("weight") * x[i] * x[j]) for i in range(k) for j in range(i, k)]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.sum("weight").alias("n"), F.array(*sums).alias("sums")).collect()}
    n = {label: float(r["n"]) for label, r in found.items()}
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return Discriminant(n.get(1, 0) / sum(n.values()) if n else 1.0)
    means, factors = [], []
    for label in (0, 1):
        s = np.array(found[label]["sums"])
        mean = s[:k] / n[label]
        square = np.zeros((k, k))
        square[np.triu_indices(k)] = s[k:] / n[label]
        cov = square + np.triu(square, 1).T - np.outer(mean, mean)
        spread = np.maximum(np.diag(cov), 0) + LEAST
        cov = (1 - shrinkage) * cov
        cov[np.diag_indices(k)] = spread  # the diagonal stays, the rest shrinks
        means.append(mean)
        factors.append(np.linalg.cholesky(cov))
    return Discriminant(n[1] / (n[0] + n[1]), means, factors)


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnt(x: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """A discriminant from measured() rows and (doc_id, quality). Labels other than 0 and 1 are left out; a document with
    several labels counts once for each; held-out documents not at all."""
    votes = (labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id", F.col("quality").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("weight")))
    return fitted(x.join(votes, "doc_id").select("x", "label", "weight"), shrinkage)


def score(x: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for measured() rows."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.asarray(batch["x"].flatten(), dtype=np.float64).reshape(-1, len(STATISTICS))
        return pa.RecordBatch.from_arrays([batch[0], pa.array(model.scores(rows))], ["doc_id", "score"])

    return map_rows(x.select("doc_id", "x"), run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score (0 to 1), predicted. Only text is an input of the score; empty and null texts
    are scored like any other. Empty tables give no rows."""
    x = materialise(measured(docs))
    return score(x, learnt(x, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those whose text the classifier rejects, all columns as they are. Texts are measured where they are read,
    so nothing but the few numbers of each text is shuffled. Null and empty texts are scored like any other, rows that repeat or lack an id go by their
    text alone; without labels of both kinds outside the held-out rows the share of label 1 (1 if there are none) decides for all. An empty table stays empty."""
    model = learnt(measured(docs), labels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = model.scores(np.array([statistics(t) for t in texts_of(batch, "text")]).reshape(-1, len(STATISTICS))) >= THRESHOLD
        return batch.filter(pa.array(good))

    return map_rows(docs, run, docs.schema, "text")
