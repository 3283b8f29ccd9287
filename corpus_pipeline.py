"""From raw documents to token ids: five stages, each written as Parquet and read again as the documents of the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis.llm import bpe, jaccard, mixing, pii, quality
from affinis.llm.queries import TOKENIZERS, table
from affinis.session import new_path

#: The steps cannot be said in SQL: classifier, shingle links and byte-level merges. tests/llm holds run() against brute force.
ORACLE_SQL = None


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return jaccard.keep_first(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts blanked, n_chars of what is left."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def weighed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents by weights raked to shares of source, language and topic."""
    return mixing.sampled(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the byte-level token ids of every text, and the digest of what they decode to."""
    return bpe.report(docs, f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


STAGES = [
    ("quality classifier", good_only),
    ("n-gram Jaccard join", one_of_each),
    ("PII", without_personal_data),
    ("mixing", weighed),
    ("byte-level BPE", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
