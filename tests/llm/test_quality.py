import numpy as np
from affinis.llm import quality
from helpers import ODD_TEXTS, empty, frame

SF = "/root/testdata/sf0.01"


def test_model_is_the_shrunk_gaussians_of_the_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(quality.STATISTICS))) * np.arange(1, 13)
    label = (rng.random(300) < 0.3).astype(int)
    x[label == 1] += 2
    model = quality.fitted(spark.createDataFrame([(x[i].tolist(), int(label[i]), 1) for i in range(300)], "x array<double>, label int, weight long"))
    logs = []
    for c in (0, 1):
        rows = x[label == c]
        cov = np.cov(rows.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.diag(np.diag(cov)) + quality.LEAST * np.eye(len(cov))
        off = rows.mean(axis=0)
        cov[~np.eye(len(cov), dtype=bool)] = ((1 - quality.SHRINKAGE) * np.cov(rows.T, bias=True))[~np.eye(len(cov), dtype=bool)]
        apart = x - off
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", apart, np.linalg.inv(cov), apart) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(rows)))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))), atol=1e-6)


def test_held_out_documents_are_told_apart_and_labels_stay_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.report(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    tested = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in tested) >= 0.97 * len(tested)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    same = got.join(quality.report(docs, flipped).withColumnRenamed("score", "other"), "doc_id")
    assert same.where("abs(score - other) > 1e-9").count() == 0


def test_odd_texts_and_missing_labels(spark):
    docs = frame(spark, ODD_TEXTS, ("score", "x", "held_out"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.report(docs, none).collect()} == {1.0}
    one = spark.createDataFrame([(i, 1) for i in range(8)] + [(None, 0), (1, None), (2, 7)], "doc_id long, quality int")
    assert {r["score"] for r in quality.report(docs, one).collect()} == {1.0}
    assert quality.report(empty(spark), one).count() == 0
    both = spark.createDataFrame([(i, i % 2) for i in range(8)] * 2, "doc_id long, quality int")
    scores = [r["score"] for r in quality.report(docs, both).collect()]
    assert len(scores) == len(ODD_TEXTS) and all(0 <= s <= 1 for s in scores)


def test_filter_keeps_what_the_report_predicts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in quality.report(docs, labels).where("predicted = 1").collect()}
