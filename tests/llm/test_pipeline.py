import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from affinis.llm import bpe, pii, quality
from affinis.llm.mixing import mixed
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_run_is_the_stages_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.report(docs, labels).where("predicted = 1").collect()}
    ids = sorted(good)
    first = {ids[c] for _, c in brute([rows[i] for i in ids]).values()}
    clean = {i: pii.blanked(rows[i], pii.spans_of(rows[i])) for i in first}
    left = docs.where(docs.doc_id.isin(*map(int, first))).drop("text").join(spark.createDataFrame(list(clean.items()), "doc_id long, text string"), "doc_id")
    sample = {r["doc_id"] for r in mixed(left).where("kept").collect()}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(path)[0].ranks, special_tokens={})
    want = {i: hashlib.sha256(np.array(engine.encode_ordinary(clean[i]), dtype="<u4").tobytes()).hexdigest() for i in sample}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if i:
            assert docs.columns == columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.ALL if n.startswith("op") or n == "pipeline"))
def test_registered_queries_are_whole(name):
    assert os.path.isdir(SF) and callable(entry.queries()[name])


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in entry.ALL if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
