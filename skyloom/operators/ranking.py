"""Exact percentiles, ranks and running sums over groups of any size: no group meets in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean
from skyloom.sources.scratch import materialize

#: A sketch finds a percentile's place within 1 / ACCURACY of a group's rows.
ACCURACY = 10_000
#: Rows of a range at most, about; a range is one window's partition.
RANGE_ROWS = 500_000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys], F.lit(True))


def percentile_pieces(rows: DataFrame, keys: Sequence[str], value, wanted: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, at, outside, rows, lo, hi): each group's values cut into pieces in order, those near a wanted percentile one by one.

    A sketch, combined before it is shuffled, brackets each percentile. The values outside all
    brackets are only counted, by the bracket that they lie behind; those within by value.
    """
    r = rows.select(*keys, clean(value).alias("v"))
    margin = 4.0 / accuracy
    edges = [F.lit(max(p - margin, 0.0)) for p in wanted] + [F.lit(min(p + margin, 1.0)) for p in wanted]
    sketch = r.groupBy(*keys).agg(F.percentile_approx("v", F.array(*edges), accuracy).alias("edges"))
    sketch = sketch.select(*[F.col(g).alias(f"_{g}") for g in keys], "edges")
    met = r.join(sketch, same_keys(r, sketch, keys)).select(*[r[g] for g in keys], "v", "edges")
    low, high = [F.get("edges", F.lit(i)) for i in range(len(wanted))], [F.get("edges", F.lit(i + len(wanted))) for i in range(len(wanted))]
    inside = F.coalesce(reduce(lambda a, b: a | b, [F.col("v").between(a, b) for a, b in zip(low, high)]), F.lit(False))
    behind = F.array_max(F.array(*[F.when(F.col("v") > b, b) for b in high]))
    pieces = met.withColumns({"outside": ~inside, "at": F.when(inside, F.col("v")).otherwise(behind)})
    return pieces.groupBy(*keys, "at", "outside").agg(F.count("v").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value, fractions: Mapping[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, one column a fraction, n, lowest, highest): exact and interpolated, NULL and non-finite values skipped.

    What meets in one task is at most 8 / accuracy of a group's different values for a fraction
    (`percentile_pieces`). The sketch's error is bounded; a percentile beyond it would be an error.
    """
    names, keys, wanted = list(fractions), list(keys), list(fractions.values())
    group = keys or ["_all"]
    pieces = percentile_pieces(rows if keys else rows.withColumn("_all", F.lit(True)), group, value, wanted, accuracy)
    so_far = Window.partitionBy(*group).orderBy(F.col("at").asc_nulls_first(), "outside")
    pieces = pieces.withColumns({"end": F.sum("rows").over(so_far.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("rows").over(Window.partitionBy(*group))})
    start = F.col("end") - F.col("rows")

    def value_at(rank: Column) -> Column:
        lost = F.raise_error(F.lit("a percentile lies beyond its sketch")).cast("double")
        here = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(rank == start, F.col("lo")).when(rank == F.col("end") - 1, F.col("hi")).otherwise(lost)
        return F.max(F.when((rank >= start) & (rank < F.col("end")), here))

    found = []
    for name, p in zip(names, wanted):
        place = p * (F.col("n") - 1)
        found += [value_at(F.floor(place)).alias(f"lo_{name}"), value_at(F.ceil(place)).alias(f"hi_{name}")]
    out = pieces.groupBy(*group).agg(F.max("n").alias("n"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"), *found)

    def between(name: str, p: float) -> Column:
        place = p * (F.col("n") - 1)
        part = place - F.floor(place)
        return (F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * part).alias(name)

    return out.select(*keys, *[between(k, p) for k, p in zip(names, wanted)], "n", "lowest", "highest")


def prefix_sums(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The rows with `before`: the sum of `value` over the rows ahead of them in their group.

    `rows` is a written table of narrow rows without NULL in its group columns. Rows are dealt
    out by ranges of group and order, each range's sum is found, and the sums of the ranges
    ahead are added to the sums within. Rows equal in `order` stand in some order.
    """
    group = list(group)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *group, *order, "tie")
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*group, "part").agg(F.sum(value).alias("total"))  # as many rows as ranges and groups
    ranges = ranges.select(*group, "part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*group, "part").orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(ranges, [*group, "part"]).withColumn("before", F.col("before") + F.col("offset")).drop("part", "offset", "tie")
