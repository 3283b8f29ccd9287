import hashlib
import random
import re

from affinis.llm import fingerprints
from helpers import ODD_TEXTS, empty, frame
from pyspark.sql import functions as F


def parts(text):
    return set(re.findall(rf"[^\n]{{1,{fingerprints.PIECE}}}", text))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts):
    order, out = sorted(range(len(texts)), reverse=True), {}
    for at, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(parts(text), parts(edited)), 9), round(likeness(parts(text), parts(following)), 9))
    return out


def test_rows_match_brute_force(spark):
    rng = random.Random(18)
    lines = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 150))) for _ in range(60)]
    texts = ["\n".join(rng.sample(lines, rng.randint(0, 40))) for _ in range(60)] + ODD_TEXTS + ["same\ntext", "same\ntext"]
    rows = fingerprints.report(frame(spark, texts, ("keys", "cells", "range", "tie", "guard"))).collect()
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows}
    assert got == brute(texts)
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[len(texts) - 1] == prints[len(texts) - 2] and len(set(prints.values())) > 50


def test_peeling_names_the_digests_of_each_side(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5]), ([], [9]), ([7], [7])], "a array<long>, b array<long>")
    got = rows.select("a", "b", fingerprints.peeled(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))), F.lit(0)).alias("d")).collect()
    for r in got:
        assert (set(r["d"]["mine"]), set(r["d"]["theirs"])) == (set(r["a"]) - set(r["b"]), set(r["b"]) - set(r["a"]))


def test_a_sketch_that_is_too_small_fails_and_a_larger_one_does_not(spark):
    rows = spark.createDataFrame([(list(range(0, 300)), list(range(150, 500)))], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    small = fingerprints.peeled(fingerprints.subtract(fingerprints.sketch(a), fingerprints.sketch(b)), F.lit(0))
    got = rows.select(small.alias("small"), fingerprints.attempt(a, b, 16).alias("large"), fingerprints.differing(a, b, fingerprints.sketch(a), fingerprints.sketch(b)).alias("n")).first()
    assert got["small"] is None and got["large"] in (350, None) and got["n"] == 350


def test_no_document_one_document_and_odd_ids(spark):
    assert fingerprints.report(empty(spark)).count() == 0
    one = fingerprints.report(frame(spark, ["abcd\nxy"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (1, "c"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in fingerprints.report(docs).collect()) == [0, 1, 1, 1, 2]


def test_main_path_is_native(spark):
    plan = fingerprints.report(frame(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
