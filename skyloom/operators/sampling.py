"""Weights on discrete states, draws from them, quantiles and convergence."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skyloom.functions.scalar import clean, col, relative_likelihood
from skyloom.operators.sorts import delta_chi2
from skyloom.sources.scratch import materialize


def normalize_weights(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), weight="weight", mask=None) -> DataFrame:
    """Adds p; masked and missing weights count as 0, negative ones or no mass are an error."""
    w = F.coalesce(clean(weight), F.lit(0.0))
    w = w if mask is None else F.when(col(mask), w).otherwise(0.0)
    totals = states.groupBy(*keys).agg(F.sum(w).alias("total_mass"), F.min(w).alias("least_mass"))
    ok = F.assert_true((F.col("least_mass") >= 0) & (F.col("total_mass") > 0), "weights must not be negative and need a mass").isNull()
    return states.join(totals, list(keys)).where(ok).withColumn("p", w / F.col("total_mass")).drop("total_mass", "least_mass")


def likelihood_weights(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """Adds delta, weight = exp(-delta / 2) and p."""
    return normalize_weights(delta_chi2(states, keys).withColumn("weight", relative_likelihood("delta")), keys)


def effective_states(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), p="p") -> DataFrame:
    return states.groupBy(*keys).agg((1.0 / F.sum(col(p) * col(p))).alias("effective_states"))


def effective_sample_size(rows: DataFrame, keys: Sequence[str], weight="weight") -> DataFrame:
    """(sum w)^2 / sum w^2 over valid weights; 0 if there are none."""
    w = F.when(clean(weight) >= 0, clean(weight))
    return rows.groupBy(*keys).agg(F.coalesce(F.try_divide(F.pow(F.sum(w), 2), F.sum(w * w)), F.lit(0.0)).alias("ess"))


def hash_uniform(*columns) -> Column:
    """In (0, 1), the same under any retry or partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def draw_states(states: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = ("target_id", "bin_id"), cell: str = "cell", p="p", grid: int = 256, first: int = 0) -> DataFrame:
    """The draws from `first` to n - 1 per key, with replacement, in proportion to p: (keys, draw_id, cell).

    Inverse distribution function as an equi-join: cumulative intervals and uniforms meet in
    cells of a grid over (0, 1); an interval appears once in each grid cell that it overlaps.
    """
    if n <= first:
        raise ValueError("at least one draw")
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(cell)
    cum = F.sum(col(p)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = states.where(col(p) > 0).select(*keys, cell, cum.alias("hi"))
    rows = rows.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).withColumn("last", F.lead("hi").over(order).isNull())
    hi = F.when(F.col("last"), F.lit(1.0)).otherwise(F.least(F.col("hi"), F.lit(1.0)))
    at = lambda v: F.least(F.lit(grid - 1), F.floor(v * grid)).cast("int")
    spread = rows.select(*keys, cell, "lo", hi.alias("hi"), F.explode(F.sequence(at(F.col("lo")), F.greatest(at(F.col("lo")), at(hi)))).alias("g"))
    draws = states.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(first), F.lit(n - 1))).alias("draw_id"))
    draws = draws.withColumn("u", hash_uniform(F.lit(seed), *keys, "draw_id")).withColumn("g", at(F.col("u")))
    return draws.join(spread, [*keys, "g"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(*keys, "draw_id", cell)


def weighted_quantiles(rows: DataFrame, quantiles: Sequence[float], keys: Sequence[str], x="x", weight="weight", tie: Sequence[str] = ()) -> DataFrame:
    """x interpolated against its cumulative mass, held at the first and last x: one column q_<percent> each."""
    keys = list(keys)
    r = rows.select(*keys, clean(x).alias("v"), clean(weight).alias("w"), *tie).where("v is not null and w >= 0")
    totals = r.groupBy(*keys).agg(F.sum("w").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    w = Window.partitionBy(*keys).orderBy("v", *tie)
    c = r.withColumn("run", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(totals, keys).where("total > 0").withColumn("c", F.col("run") / F.col("total"))
    c = c.withColumns({"c0": F.lag("c").over(w), "v0": F.lag("v").over(w)})
    out = []
    for q in quantiles:
        here = (F.col("c") >= q) & (F.col("c0") < q)
        mid = F.col("v0") + (F.col("v") - F.col("v0")) * F.try_divide(q - F.col("c0"), F.col("c") - F.col("c0"))
        first = F.max(F.when(F.col("c0").isNull() & (F.col("c") >= q), F.col("v")))
        out.append(F.coalesce(F.min(F.when(here, mid)), first, F.max("high")).alias(f"q_{round(q * 100):02d}"))
    return c.groupBy(*keys).agg(*out)


def quantile_convergence(batches: DataFrame, keys: Sequence[str], fraction: float = 0.05, floor: float = 0.0, order: str = "batch", passes: int = 1) -> DataFrame:
    """Per batch: the largest change of p16, p50, p84, the tolerance, whether it converged, and for how many batches on end."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.greatest(*[F.abs(F.col(c) - F.lag(c).over(w)) for c in ("p16", "p50", "p84")])
    tolerance = F.greatest(F.lit(floor), fraction * F.greatest(F.col("p84") - F.col("p16"), F.lit(0.0)))
    rows = batches.withColumns({"change": change, "tolerance": tolerance})
    rows = rows.withColumn("converged", F.coalesce(F.col("change") < F.col("tolerance"), F.lit(False)))
    broken = F.sum((~F.col("converged")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("island", broken)
    run = F.sum(F.col("converged").cast("int")).over(Window.partitionBy(*keys, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("passes", run).withColumn("done", F.col("passes") >= passes).drop("island")


#: Steps of a plane-filling Kronecker sequence, powers of the plastic number.
PLASTIC = (0.7548776662466927, 0.5698402909980532)
#: Draws in memory at one time in a task, some megabytes.
CELLS = 500_000


def inclination_prior(targets: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Percentiles of the inclination for Gaussian axis ratio q +- qe and thickness q0 +- q0e, per target.

    The draws fill the plane evenly (a Kronecker sequence, moved on by the seed), so few of them
    give what many random ones do, and reruns agree. They are the same for all targets, so a target
    is one row throughout: its angles and their percentiles are found in place, many targets at once.
    """
    draw = np.arange(1, n + 1) + float(seed)
    u, v = (0.5 + draw * s for s in PLASTIC)
    radius, turn = np.sqrt(-2 * np.log(u - np.floor(u))), 2 * np.pi * (v - np.floor(v))
    along, across = radius * np.cos(turn), radius * np.sin(turn)

    def clipped(mean: np.ndarray, error: np.ndarray, steps: np.ndarray, low: float, high: float) -> np.ndarray:
        x = mean[:, None] + error[:, None] * steps
        return np.clip(np.where(np.isnan(x), np.inf, x), low, high)  # as SQL orders them, NaN last

    def angles(parts: Sequence[np.ndarray]) -> np.ndarray:
        q, q0 = clipped(parts[0], parts[1], along, 1e-4, 1.0), clipped(parts[2], parts[3], across, 0.0, 0.999)
        q0 *= q0
        return np.degrees(np.arccos(np.sqrt(np.clip((q * q - q0) / (1 - q0), 0.0, 1.0))))

    def percentiles(values: np.ndarray) -> np.ndarray:
        values, out = np.sort(values, axis=1), []
        for p in (0.16, 0.5, 0.84):
            place = p * (values.shape[1] - 1)
            low, high = math.floor(place), math.ceil(place)
            out.append(values[:, low] if low == high else (high - place) * values[:, low] + (place - low) * values[:, high])
        return np.stack(out, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            start = np.cumsum(size) - size
            parts = [batch.column(c).flatten().to_numpy() for c in ("q", "qe", "q0", "q0e")]
            found = np.empty((len(size), 3))
            for k in np.unique(size):  # a target has one row, or else its rows' draws count together
                alike = np.flatnonzero(size == k)
                step = max(1, CELLS // int(k * n))
                for rows in (alike[i : i + step] for i in range(0, len(alike), step)):
                    at = (start[rows][:, None] + np.arange(k)).ravel()
                    found[rows] = percentiles(angles([x[at] for x in parts]).reshape(len(rows), -1))
            yield pa.RecordBatch.from_arrays([batch.column("target_id"), *[pa.array(x) for x in found.T]], names=["target_id", "p16", "p50", "p84"])

    def known(mean: str, error: str, least: float) -> list[Column]:
        """Where either is NULL, SQL's greatest is the least value."""
        m, e = F.col(mean).cast("double"), F.col(error).cast("double")
        there = m.isNotNull() & e.isNotNull()
        return [F.when(there, m).otherwise(least).alias(mean), F.when(there, e).otherwise(0.0).alias(error)]

    rows = targets.select("target_id", F.struct(*known("q", "qe", 1e-4), *known("q0", "q0e", 0.0)).alias("row"))
    rows = rows.groupBy("target_id").agg(F.collect_list("row").alias("rows"))
    rows = rows.select("target_id", F.size("rows").alias("size"), *[F.col(f"rows.{c}").alias(c) for c in ("q", "qe", "q0", "q0e")])
    return rows.mapInArrow(run, StructType([targets.schema["target_id"], *[StructField(c, DoubleType()) for c in ("p16", "p50", "p84")]]))


def sample_until_converged(
    states: DataFrame, x: str, *, least: int = 1000, batch: int = 500, most: int = 20_000, fraction: float = 0.05, floor: float = 0.0, passes: int = 1, seed: int = 0,
    keys: Sequence[str] = ("target_id", "bin_id"), cell: str = "cell", p: str = "p",
) -> tuple[DataFrame, DataFrame]:
    """(summary, history): draws from each surface until the percentiles of `x` settle or the draws run out.

    All bins start with `least` draws; those that have not converged get `batch` more in each round,
    so a round works on the bins that are left. history: keys, batch, n_draws and the percentiles of all
    draws so far, with the change; summary: the last batch of each bin, converged, and at_limit where
    `most` draws did not do. `states`: keys, cell, p, x; p sums to 1 over a bin.
    """
    if not 0 < least <= most or batch < 1:
        raise ValueError("draws start at one or more, grow, and are not beyond their limit")
    keys, number, n = list(keys), 0, least
    states = materialize(states.select(*keys, cell, p, x), "draw-states")
    active, drawn, history, seen = states, None, None, 0
    while True:
        new = draw_states(active, n, seed=seed, keys=keys, cell=cell, p=p, first=seen).join(active.select(*keys, cell, x), [*keys, cell])
        new = materialize(new.select(*keys, clean(x).alias(x)), "draws")
        drawn = new if drawn is None else drawn.join(active.select(*keys).distinct(), keys, "left_semi").unionByName(new)
        found = drawn.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84))).alias("v"))  # at most `most` draws a bin
        found = found.select(*keys, F.lit(number).alias("batch"), F.lit(n).alias("n_draws"), *[F.col("v")[k].alias(c) for k, c in enumerate(("p16", "p50", "p84"))])
        history = materialize(found if history is None else history.unionByName(found), "draw-history")
        judged = quantile_convergence(history, keys, fraction, floor, passes=passes)
        open_ = materialize(judged.where((F.col("batch") == number) & ~F.col("done")).select(*keys), "draw-open")
        if n >= most or open_.isEmpty():
            break
        active, seen, number, n = states.join(open_, keys, "left_semi"), n, number + 1, min(n + batch, most)
    judged = judged.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("batch").desc())))
    last = judged.where("nth = 1").select(*keys, "n_draws", "p16", "p50", "p84", F.col("done").alias("converged"), (~F.col("done")).alias("at_limit"))
    return last, judged.drop("nth")
