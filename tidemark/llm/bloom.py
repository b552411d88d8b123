"""A blocked Bloom filter in column expressions, of a bounded size and so safe to broadcast.

Each key falls into one 512-bit block of eight 64-bit words and sets one bit in each word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block; one bit is set in each.
WORDS = 8
#: The filter never outgrows this size: beyond it, more keys share its bits, so that more rows pass it. What
#: passes is held against the keys themselves, so results stay the same.
FILTER_BYTES = 32 << 20


def _bits(key: Column) -> list[Column]:
    """A mask with one bit for each word of a block."""
    spread = F.xxhash64(key, F.lit(2))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(spread, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def blocks_for(keys: int, bits_per_key: int) -> int:
    """Blocks of a filter of so many keys: a power of two, within the size."""
    wanted, blocks = keys * bits_per_key / (64 * WORDS), 1
    while blocks < wanted and 2 * blocks * (WORDS + 1) * 8 <= FILTER_BYTES:
        blocks *= 2
    return blocks


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter's blocks that have bits. keys: (key)."""
    masks = [m.alias(f"m{i}") for i, m in enumerate(_bits(F.col("key")))]
    return (
        keys.select(_block(F.col("key"), blocks).alias("block"), *masks)
        .groupBy("block")
        .agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def with_possible(rows: DataFrame, key: str, keys: DataFrame, blocks: int) -> DataFrame:
    """rows with `possible`: false where the column `key` surely isn't among the keys: (key), or is null."""
    bloom = F.broadcast(bloom_blocks(keys, blocks).withColumnRenamed("block", "_block"))
    set_ = F.lit(True)
    for i, m in enumerate(_bits(F.col(key))):
        set_ = set_ & (F.col(f"w{i}").bitwiseAND(m) != 0)
    # A null key has no block to look up.
    looked = rows.withColumn("_block", F.when(F.col(key).isNotNull(), _block(F.col(key), blocks))).join(bloom, "_block", "left")
    return looked.select(*rows.columns, F.coalesce(set_, F.lit(False)).alias("possible"))
