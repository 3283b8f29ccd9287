"""A blocked Bloom filter as a small table: one row of eight words for each block of 256 bits.

A key sets one bit in each word of one block. The filter is bounded by MOST_BLOCKS at any size of the key set: with more keys
it fills up and lets more rows pass. So it only ever goes before an exact join, whose result does not depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 8
#: Bits a key gets while the filter has room, and the most blocks: 2^18 rows, 8 MB of bits, which bounds what is broadcast.
BITS_PER_KEY, MOST_BLOCKS = 16, 1 << 18


@dataclass
class Bloom:
    blocks: int
    rows: DataFrame


def place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def bits(key: Column) -> list[Column]:
    """For each word the bit of a key: five bits of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def build(keys: DataFrame, key: str, count: int) -> Bloom:
    """Filter of the column `key`; `count` is the number of its keys and only sets the size. Null keys are left out."""
    blocks = max(1, min(MOST_BLOCKS, -(-count * BITS_PER_KEY // (32 * WORDS))))
    k = F.col(key)
    words = keys.where(k.isNotNull()).select(place(k, blocks).alias("bloom_block"), *[b.alias(f"w{i}") for i, b in enumerate(bits(k))])
    merged = words.groupBy("bloom_block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    return Bloom(blocks, merged.select("bloom_block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("bloom_words")))


def possible(rows: DataFrame, key: str, bloom: Bloom, flag: str) -> DataFrame:
    """`rows` and a column `flag`: false where the key is certainly not in the filter. A broadcast of at most MOST_BLOCKS rows."""
    k = F.col(key)
    marked = rows.withColumn("bloom_block", place(k, bloom.blocks)).join(F.broadcast(bloom.rows), "bloom_block", "left")
    hit = F.lit(True)
    for i, b in enumerate(bits(k)):
        hit = hit & (F.col("bloom_words")[i].bitwiseAND(b) != 0)
    return marked.withColumn(flag, F.coalesce(k.isNotNull() & F.col("bloom_words").isNotNull() & hit, F.lit(False))).drop("bloom_block", "bloom_words")
