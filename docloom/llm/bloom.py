"""Blocked Bloom filters as tables: built, held and tested by column expressions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A block is a cache line: eight words of 64 bits. A key sets one bit in each word.
WORDS = 8
BLOCK_BITS = 64 * WORDS
# The table that is broadcast has at most this many rows of nine numbers, 4.7 MB of data. Beyond
# it the filter lets more keys pass, which costs time in the exact join but never changes a result.
MAX_BLOCKS = 1 << 16
SALT = 0x51ED


@dataclass(frozen=True)
class BlockedBloom:
    table: DataFrame
    blocks: int

    def flag(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """Add ``name``: false if ``key`` is certainly not in the list, or null."""
        keyed = df.withColumn("_block", _block(key, self.blocks))
        joined = keyed.join(F.broadcast(self.table), "_block", "left")
        hit = F.lit(True)
        for i, bit in enumerate(_bits(key)):
            hit = hit & (F.col(f"_w{i}").bitwiseAND(bit) != 0)
        return joined.select(*df.columns, F.coalesce(hit & key.isNotNull(), F.lit(False)).alias(name))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bit that a key has in each word: six bits of a second hash each."""
    other = F.xxhash64(key, F.lit(SALT))
    one = F.lit(1).cast("long")
    return [
        F.call_function("shiftleft", one, F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(WORDS)
    ]


def build(listed: DataFrame, key: str, bits_per_key: int = 16, max_blocks: int = MAX_BLOCKS) -> BlockedBloom:
    """The filter of a list of keys; null keys are left out. ``listed`` is read twice."""
    keys = listed.where(F.col(key).isNotNull())
    wanted = keys.count() * bits_per_key // BLOCK_BITS + 1
    blocks = min(max_blocks, 1 << (wanted - 1).bit_length())
    words = keys.select(
        _block(F.col(key), blocks).alias("_block"), *[b.alias(f"_w{i}") for i, b in enumerate(_bits(F.col(key)))]
    )
    table = words.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])
    return BlockedBloom(table, blocks)
