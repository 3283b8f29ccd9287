"""Stages of the pipeline on odd rows: null, empty, blank, repeated and very long texts, ids that are missing or repeat, clashing names, empty tables."""

from affinis.llm import jaccard, pii, quality
from helpers import ODD_TEXTS, empty, frame

IDS = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "q r s"), (2, "q r s"), (None, "z")]


def seen(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_good_texts_stay_whatever_the_row(spark):
    docs = frame(spark, ODD_TEXTS, ("x", "score", "label", "weight", "id"))
    labels = spark.createDataFrame([(i, int(i in (3, 4, 5, 7))) for i in range(8)] * 3, "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    good = {r["doc_id"] for r in quality.report(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and 0 < len(good) < len(ODD_TEXTS)
    assert seen(kept) == seen(docs.where(docs.doc_id.isin(*good)))
    none = labels.where("false")
    assert seen(quality.keep_good(docs, none)) == seen(docs)  # nothing is known against any text
    assert quality.keep_good(empty(spark), labels).count() == 0
    odd = spark.createDataFrame(IDS, "doc_id long, text string")
    assert seen(quality.keep_good(odd, none)) == seen(odd)


def test_first_of_each_group_stays(spark):
    docs = spark.createDataFrame(IDS, "doc_id long, text string")
    # Rows of id 5 go together: one of them is a copy of id 2's.
    assert seen(jaccard.keep_first(docs)) == seen(docs.where("doc_id IS NULL OR doc_id = 2"))
    odd = frame(spark, ODD_TEXTS, ("n_shingles", "set_id", "root", "a", "b"))
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns and seen(kept) == seen(odd.where("doc_id <> 4"))
    assert jaccard.keep_first(empty(spark)).count() == 0


def test_personal_data_goes_from_long_and_odd_texts(spark):
    texts = ODD_TEXTS + ["x " * 50_000 + "write to ann@example.org now", "ann@example.org"] * 2
    docs = frame(spark, texts, ("spans", "id", "kind"))
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == len(texts)
    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    assert [rows[i] for i in range(len(ODD_TEXTS))] == ODD_TEXTS
    assert all("ann@" not in rows[i] for i in range(len(ODD_TEXTS), len(texts))) and rows[8].startswith("x " * 50_000 + "write to ")
    assert pii.redact(empty(spark)).count() == 0
    nulls = spark.createDataFrame(IDS, "doc_id long, text string")
    assert seen(pii.redact(nulls)) == seen(nulls)
