"""Best rows, rankings and set operations; ties always go to the first in row-major order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean, col
from skyloom.operators.ranking import exact_percentiles, prefix_sums
from skyloom.sources.scratch import materialize


def brightest(image: DataFrame, keys: Sequence[str] = ("target_id", "arm"), value="value") -> DataFrame:
    v = clean(value)
    best = F.max(F.struct(v.alias("value"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("best")
    return image.where(v > 0).groupBy(*keys).agg(best).select(*keys, (-F.col("best.y")).alias("y"), (-F.col("best.x")).alias("x"), F.col("best.value").alias("value"))


def low_flux_selection(image: DataFrame, percent: float, at_most: int, keys: Sequence[str] = ("target_id", "arm"), value="value") -> DataFrame:
    """Good pixels at or below a percentile, thinned evenly in row-major order to `at_most` per key."""
    keys = list(keys)
    good = materialize(image.where("good").select(*keys, "y", "x", clean(value).alias("v")), "low-flux")
    limits = exact_percentiles(good, keys, "v", {"limit": percent / 100}).select(*keys, "limit")
    rows = good.join(limits, keys) if keys else good.crossJoin(F.broadcast(limits))
    rows = materialize(rows.where(F.col("limit").isNull() | (F.col("v") <= F.col("limit"))).withColumn("one", F.lit(1)), "low-flux")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = prefix_sums(rows, keys, ["y", "x"], "one").withColumnRenamed("before", "nth")
    rows = rows.join(sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))
    if at_most < 2:
        return rows.where(F.col("nth") < at_most).select(*keys, "y", "x", F.col("v").alias("value"))
    # position k of a linspace over 0 .. n - 1 falls on row nth for some k below at_most
    step = (F.col("n") - 1) / F.lit(float(at_most - 1))
    k = F.ceil(F.col("nth") / step)
    hit = (k < at_most) & (F.floor(k * step) == F.col("nth"))
    return rows.where((F.col("n") <= at_most) | hit).select(*keys, "y", "x", F.col("v").alias("value"))


def worst_bins(bins: DataFrame, top: int, value="legacy") -> DataFrame:
    return bins.where(clean(value).isNotNull()).orderBy(col(value), "bin_id").limit(top)


def rank_windows(scan: DataFrame, top: int) -> DataFrame:
    return scan.where(clean("median_sn").isNotNull()).orderBy(F.col("positive_fraction").desc(), F.col("median_sn").desc(), "window_id").limit(top)


def best_state(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    best = F.min(F.struct("chi2", "ia", "ib", "jf")).alias("best")
    return states.where(clean("chi2").isNotNull()).groupBy(*keys).agg(best).select(*keys, "best.ia", "best.ib", "best.jf", "best.chi2")


def profile_over(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), over: str = "jf", kept: Sequence[str] = ("ia", "ib")) -> DataFrame:
    """Per kept cell the least chi2 over the other axis, where it is attained, and its distance to the surface minimum."""
    best = F.min(F.struct("chi2", over)).alias("best")
    cells = states.where(clean("chi2").isNotNull()).groupBy(*keys, *kept).agg(best).select(*keys, *kept, F.col("best.chi2").alias("chi2"), F.col(f"best.{over}").alias(over))
    least = cells.groupBy(*keys).agg(F.min("chi2").alias("least"))
    return cells.join(least, list(keys)).withColumn("delta", F.col("chi2") - F.col("least")).drop("least")


def delta_chi2(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), reference: float | None = None) -> DataFrame:
    if reference is not None:
        return states.withColumn("delta", clean("chi2") - reference)
    least = states.groupBy(*keys).agg(F.min(clean("chi2")).alias("least"))
    return states.join(least, list(keys)).withColumn("delta", clean("chi2") - F.col("least")).drop("least")


def mass_cell_counts(states: DataFrame, masses: Sequence[float], keys: Sequence[str] = ("target_id", "bin_id"), order: Sequence[str] = ("ia", "ib", "jf")) -> DataFrame:
    """Per mass the smallest number of cells, heaviest first, whose weights reach it. One bin's cells are ranked together."""
    if not all(0 < m <= 1 for m in masses):
        raise ValueError("masses lie in (0, 1]")
    rows = states.select(*keys, *order, clean("weight").alias("w")).where("w > 0")
    totals = rows.groupBy(*keys).agg(F.sum("w").alias("total"))
    w = Window.partitionBy(*keys).orderBy(F.col("w").desc(), *order).rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.withColumn("running", F.sum("w").over(w)).join(totals, list(keys)).withColumn("cum", F.round(F.col("running") / F.col("total"), 12))
    counts = [F.least(F.count("*"), 1 + F.count_if(F.col("cum") < m)).alias(f"n_{str(m).replace('.', '_')}") for m in masses]
    return cum.groupBy(*keys).agg(*counts)


def nearest_zero_pixel(spaxels: DataFrame, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    best = F.min(F.struct(F.hypot("x_arcsec", "y_arcsec").alias("r"), "y", "x")).alias("best")
    return spaxels.groupBy(*keys).agg(best).select(*keys, "best.y", "best.x", "best.r")


def example_bins(bins: DataFrame, flag: str, top: int = 8, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    """The first ids with the flag, as one array per key; rows of one id stand in the order of their numbers.

    Each task keeps the first `top` of what it reads, so at most `top` rows a key and task are shuffled.
    """
    keys = list(keys)
    rows = bins.where(flag).select(*keys, F.struct("bin_id", "n_good", "sn").alias("row")).withColumn("task", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy(*keys, "task").orderBy("row"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= top)  # a filter on ranks is pushed below the shuffle
    return first.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("row")), 1, top).alias("examples"))


def contiguous_ids(rows: DataFrame, keys: Sequence[str] = ("target_id",), value: str = "bin_id") -> DataFrame:
    """(keys, value, new_id): distinct ids of each target numbered from 0; a target of any size is numbered by ranges."""
    ids = materialize(rows.select(*keys, value).distinct().withColumn("one", F.lit(1)), "ids")
    return prefix_sums(ids, keys, [value], "one").select(*keys, value, F.col("before").alias("new_id"))


def top_messages(states: DataFrame, top: int = 5) -> DataFrame:
    return states.where("status <> 0").groupBy("message").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "message").limit(top)


def union_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("component", F.lit(0)).unionByName(b.withColumn("component", F.lit(1)))


def difference(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.distinct().exceptAll(present.distinct())


def pending(every: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return every.join(done.select(*keys).distinct(), list(keys), "left_anti")


def intersect_masks(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_semi")


def header_key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").union(b.select("key")).distinct()


def distinct_flags(flags: DataFrame, keys: Sequence[str] = ("target_id", "run_id")) -> DataFrame:
    """Each flag once per run, at its first place, with the detail given there."""
    first = F.min(F.struct("seq", "detail")).alias("first")
    return flags.groupBy(*keys, "flag").agg(first).select(*keys, "flag", F.col("first.seq").alias("seq"), F.col("first.detail").alias("detail"))
