"""Bloom filters in built-in functions: blocks of 32,768 bits, one block per key.

A key sets ``PROBES`` bits of one block (about 16 bits a key); ``bitmap_construct_agg``
makes a block's bits, combined before the shuffle. A filter is a table of blocks,
so it may be stored, and asking it is an equality join on the block, broadcast
where the blocks are counted to be few. There are no false negatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768  # what one bitmap aggregate holds
BLOCK_KEYS = 2_048
PROBES = 4
#: Blocks (4 KB each) that are broadcast, at most.
BROADCAST_BLOCKS = 4_096


def block_of(key: Column, blocks: int | Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), blocks).cast("long")


def probes(key: Column) -> Column:
    """PROBES bit positions from one more hash, 15 bits each."""
    h = F.xxhash64(key, F.lit(2))
    return F.array(*[F.shiftright(h, 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(PROBES)])


def holds(bits: Column, positions: Column) -> Column:
    byte = lambda p: F.conv(F.hex(F.substring(bits, (F.shiftright(p, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    return F.forall(positions, lambda p: F.getbit(byte(p), p.bitwiseAND(F.lit(7)).cast("int")) == 1)


def bits_of(keys: DataFrame, key: str, blocks: int, *by: str) -> DataFrame:
    """(by, block, bits) of the keys."""
    k = F.col(key)
    return (keys.select(*by, block_of(k, F.lit(blocks)).alias("block"), F.explode(F.array_distinct(probes(k))).alias("at"))
            .groupBy(*by, "block").agg(F.bitmap_construct_agg("at").alias("bits")))


class KeyFilter:
    """A filter over one column of a table."""

    def __init__(self, bits: DataFrame, blocks: int):
        self.bits, self.blocks = bits, blocks

    @classmethod
    def of(cls, keys: DataFrame, key: str) -> KeyFilter:
        """Built by two jobs over the keys: a count and the bits."""
        distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()
        blocks = max(1, -(-distinct.count() // BLOCK_KEYS))
        return cls(bits_of(distinct, key, blocks), blocks)

    def may_hold(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of ``df`` whose key is in the filter, and few others; none with a null key.

        A semi join, as Catalyst moves a later semi join on ``df``'s columns below an inner
        one, and with it the shuffle that the filter is to spare."""
        bits = self.bits.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
        if self.blocks <= BROADCAST_BLOCKS:
            bits = F.broadcast(bits)
        key = F.col(key)
        asked = df.where(key.isNotNull())
        return asked.join(bits, (block_of(key, F.lit(self.blocks)) == F.col("_block")) & holds(F.col("_bits"), probes(key)), "left_semi")
