"""Exact deduplication over an extendible-hash index kept in the shared folder.

1. Every row's key is a hash of its normalised text. Rows are counted per key
   before anything else moves, so a group of copies is one index record.
2. The directory starts with one bucket. A bucket with more than `capacity` keys
   doubles the directory for its key range: one more leading bit of the key.
   All depths are summed from one histogram of key prefixes, and the leaves are
   the first ranges that fit (`directory`).
3. Owner tasks each write the pages of their key ranges, sorted by key.
4. Keys with two or more rows are probed again with their texts. Grouping by
   (bucket, key, text) chains the different texts of one key and compares bytes;
   copies are collapsed before the shuffle.

Nulls in the text count as empty. Rows repeating both doc_id and text are copies
of each other and exactly one of them stays; a null doc_id counts as the smallest.
An empty table gives an empty result. Extra columns are ignored unless named in
`payload`, which is carried through untouched. Texts of any length are compared whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import ascii_lower, materialize, small_side, whole_text

CAPACITY = 4096
BROADCAST_ROWS = 50_000
#: Copies of one text that look up their chain together.
SALT_ROWS = 10_000


def text_key(norm: Column, hash_bits: int = 64) -> Column:
    """The leading `hash_bits` bits of a 64-bit hash; few bits make collisions, as tests do."""
    h = F.xxhash64(norm)
    return h if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)


def prefix(key: Column, bits: int) -> Column:
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(key, 64 - bits)


def directory(keys: DataFrame, n_keys: int, capacity: int) -> tuple[DataFrame, int]:
    """Slots of the doubled directory: (slot, bucket, depth), and the global depth.

    `bucket` names a key range as "depth:prefix". A range is a leaf if it holds at most
    `capacity` keys, or the global depth is reached, while its parent holds more.
    """
    deepest = min(40, max(0, math.ceil(math.log2(max(1, n_keys) / capacity)) + 3)) if n_keys > capacity else 0
    slots = keys.groupBy(prefix(F.col("key"), deepest).alias("slot")).agg(F.count("*").alias("n"))
    ranges = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
    at = F.expr(f"shiftrightunsigned(slot, {deepest} - depth)")
    sizes = ranges.groupBy("depth", at.alias("range")).agg(F.sum("n").alias("n"))
    parents = sizes.select((F.col("depth") + 1).alias("depth"), F.col("range").alias("parent"), F.col("n").alias("parent_n"))
    leaves = (
        sizes.withColumn("parent", F.shiftrightunsigned("range", 1))
        .join(parents, ["depth", "parent"], "left")
        .where(((F.col("n") <= capacity) | (F.col("depth") == deepest)) & (F.col("parent_n").isNull() | (F.col("parent_n") > capacity)))
        .select("depth", "range")
    )
    found = (
        ranges.withColumn("range", at)
        .join(leaves, ["depth", "range"])
        .select("slot", F.concat_ws(":", "depth", "range").alias("bucket"), "depth")
    )
    return found, deepest


def build_index(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index pages: bucket, key, n (rows of the key); written by the owners of the buckets."""
    keys = materialize(keys, "dedup-keys")
    n_keys = keys.count()
    slots, deepest = directory(keys, n_keys, capacity)
    slots = materialize(slots, "dedup-directory")
    if slots.count() <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    placed = keys.withColumn("slot", prefix(F.col("key"), deepest)).join(slots, "slot")
    return materialize(placed.select("bucket", "key", "n").repartition("bucket").sortWithinPartitions("bucket", "key"), "dedup-index")


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", payload: tuple[str, ...] = (), capacity: int = CAPACITY, hash_bits: int = 64
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, then `payload`."""
    carried = F.struct(*[F.col(c) for c in payload]).alias("carried") if payload else F.lit(None).cast("string").alias("carried")
    norm = ascii_lower(whole_text(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), carried).withColumn("key", text_key(F.col("norm"), hash_bits))
    index = build_index(rows.groupBy("key").agg(F.count("*").alias("n")), capacity)
    shared = small_side(materialize(index.where(F.col("n") > 1).select("key", "bucket", "n"), "dedup-shared"))

    hashed = rows.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"), "carried")
    single = hashed.join(shared, "key", "left_anti").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
        "carried",
    )
    suspects = rows.join(shared, "key").withColumn("rid", F.monotonically_increasing_id())
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")  # the copies of one text look up their chain in many tasks
    suspects = materialize(suspects.withColumn("salt", F.pmod(F.xxhash64("rid"), salts).cast("int")), "dedup-suspects")
    chains = suspects.groupBy("bucket", "key", "n", "norm").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("keep")
    )
    chains = materialize(chains, "dedup-chains").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    copies = suspects.join(chains, ["bucket", "key", "salt", "norm"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"),
        "carried",
    )
    out = single.unionByName(copies)
    return out.select(*out.columns[:-1], *[F.col(f"carried.{c}").alias(c) for c in payload])
