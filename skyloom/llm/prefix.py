"""Running sums over groups of any size: ranges are summed first, so no group meets in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import materialize

#: Rows of a range at most, about; a range is one window's partition.
RANGE_ROWS = 500_000


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The rows with `before`: the sum of `value` over the rows ahead of them in their group.

    `rows` is a written table of narrow rows; its group columns hold no nulls, those of `order`
    may (nulls first). Rows are dealt out by ranges of group and order, each range's sum is
    found, and the sums of the ranges ahead are added to the sums within. Rows that are equal
    in `order` stand in some order; their place in the table keeps a crowd of them apart.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *group, *order, "tie")
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "prefix-ranges")
    ahead = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*group, "part").agg(F.sum(value).alias("total"))  # as many rows as ranges and groups
    ranges = ranges.select(*group, "part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*group, "part").orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(ranges, [*group, "part"]).withColumn("before", F.col("before") + F.col("offset")).drop("part", "offset", "tie")
