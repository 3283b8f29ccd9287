"""Registered queries of the numbered operators: each reads whole tables of the folder and applies its operator.

SQL stands beside the queries that SQL can express; the others are held against brute force in tests/llm.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from affinis.llm import ann, bpe, clusters, conversations, fingerprints, jaccard, mixing, passages, pii, quality, rules, token_files, urls
from affinis.session import new_path

#: Where the vocabulary files of public tokenizers lie on every worker.
TOKENIZERS = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL judged by the rules, then by the list of feed targets."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, urls.feed_targets(pages))


SQL["op1_url_filter"] = urls.SQL


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's ids in Huffman-coded files, read back."""
    return token_files.report(table(spark, folder, "documents"), new_path(spark, "tokens"), f"{TOKENIZERS}/word_bpe_49k.json", 2)


@query
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.report(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


@query
def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@query
def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every text without the bytes of 50-byte strings that start in earlier documents."""
    return passages.report(table(spark, folder, "documents"))


@query
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document beside its edited text and the next document."""
    return fingerprints.report(table(spark, folder, "documents"))


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Weight and sampling rate of every document, and whether it is drawn."""
    return mixing.mixed(table(spark, folder, "documents"))


@query
def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"))


@query
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    return pii.report(table(spark, folder, "documents"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every text scored by the discriminant learnt from the labels."""
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels").select("doc_id", "quality"))


@query
def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every text measured and judged by the base rules, then by thresholds of its language and source."""
    return rules.judged(table(spark, folder, "documents"))


SQL["op11_quality_rules"] = rules.SQL


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return conversations.report(table(spark, folder, "conversations"))


SQL["op12_conversation_repair"] = conversations.SQL


@query
def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's cluster after ten rounds."""
    return clusters.clustered(table(spark, folder, "embeddings").select("vec_id", "embedding"))


SQL["op13_centroid_clustering"] = clusters.SQL
