"""Mixing sources to target weights, down to the word.

1. A row's size is its number of words. Sources in their order get the weights in turn and
   share the words of the whole corpus by them. No source gives more than `most` times its
   size: what it cannot give goes to the others by weight. That is one water level for all,
   `target = least(most * size, level * weight)`, found in a few sums over the sources.
2. Each row gets a hash-random key from its id and a seed. Rows are range-sorted by key
   within their source, and prefix sums of the sizes are found by ranges (`prefix_sums`), so
   a source that holds most rows is spread like any other.
3. A source's budget is its target as a whole number. As often as the budget holds the
   source, all rows are taken; the last epoch takes rows in key order and cuts the row in
   which the budget ends, so the words taken are exactly the budget.

A null text has no words. A null source is a source of its own, the last; an empty one is another.
Null ids are one key. Rows with equal ids stand by size and then in some order among equals;
the same rows give the same result whatever their partitions. Sources without words have a
target of 0. An empty table gives an empty result, extra columns are ignored, and texts of any
length are counted whole. Only Spark's own functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialize, whole_text
from skyloom.llm.prefix import prefix_sums

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def random_key(id_text: Column, seed: int) -> Column:
    """64 bits of a digest as hex letters: as good as random, and the same on every run."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit("-"))), 256), 1, 16)


def water_level(sources: DataFrame, most: int) -> float:
    """The level at which least(most * source_size, level * weight) sums to all words."""
    level = 0.0
    while True:
        full = most * F.col("source_size") <= F.lit(level) * F.col("weight")
        sums = sources.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not sums["free"]:
            return level
        higher = (sums["words"] - sums["given"]) / sums["free"]
        if higher <= level:
            return level
        level = higher


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(absent, name, source_size, weight, target) for each source of the rows (absent, name, size), a written table."""
    sizes = rows.groupBy("absent", "name").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
    placed = prefix_sums(materialize(sizes, "mix-sources"), [], ["absent", "name"], "one").drop("one")
    turn = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights)).cast("int"))
    weighed = materialize(placed.select("absent", "name", "source_size", turn.alias("weight")), "mix-weights")
    level = water_level(weighed, most)
    return weighed.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight")))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 13
) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken, source."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).isNull().alias("absent"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        random_key(F.col(id_col).cast("string"), seed).alias("key"),
    )
    rows = materialize(rows, "mix-sizes")
    targets = source_targets(rows, weights, most)
    placed = prefix_sums(rows, ["absent", "name"], ["key", "doc_id", "size"], "size").join(targets, ["absent", "name"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.coalesce(F.expr("floor(target + 0.5) div nullif(source_size, 0)"), F.lit(0))
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + last).cast("long").alias("taken"),
        F.when(~F.col("absent"), F.col("name")).alias("source"),
    )
