"""A sieve of keys: a table of bit blocks, of bounded size, that lets through all keys of a set and few others.

Rows are tried in place before they are shuffled to the set. The sieve has at most `blocks`
rows of two numbers whatever the size of the set, so it is always broadcast; a set too large
for it only makes it coarser. What passes is settled by an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sieve at most, some 40 megabytes where it is joined.
BLOCKS = 1 << 20


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks))


def _bits(h: Column) -> Column:
    """Three of a block's 64 bits, by other bits of the hash than the block."""
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int"))
    return one(24).bitwiseOR(one(33)).bitwiseOR(one(42))


def sieve_of(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, bits) over the keys."""
    h = F.xxhash64(key)
    return keys.select(_block(h, blocks).alias("block"), _bits(h).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def sifted(rows: DataFrame, key: str, sieve: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The rows whose key may be in the set; none whose key is in it is lost."""
    h = F.xxhash64(key)
    tried = rows.withColumns({"block": _block(h, blocks), "wanted": _bits(h)}).join(F.broadcast(sieve), "block")
    return tried.where(F.col("bits").bitwiseAND(F.col("wanted")) == F.col("wanted")).select(*rows.columns)


def marked(rows: DataFrame, key: str, sieve: DataFrame, name: str, blocks: int = BLOCKS) -> DataFrame:
    """The rows with `name`: whether their key may be in the set."""
    h = F.xxhash64(key)
    tried = rows.withColumns({"block": _block(h, blocks), "wanted": _bits(h)}).join(F.broadcast(sieve), "block", "left")
    return tried.select(*rows.columns, F.coalesce(F.col("bits").bitwiseAND(F.col("wanted")) == F.col("wanted"), F.lit(False)).alias(name))
