"""Later analysis stages: trial models, basins as posteriors, joint minima, populations, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean, deproject, projected_velocity, relative_likelihood
from skyloom.operators import aggregates as A
from skyloom.operators import sampling as P
from skyloom.operators import sorts as S
from skyloom.operators.grids import AXES, basins
from skyloom.sources.scratch import materialize, small_side

BIN = ("target_id", "bin_id")


def outer_radius(peaks: DataFrame, start: float, space: float) -> DataFrame:
    """max of the outermost radii on either side, snapped to the ring grid. `peaks`: target_id, r (signed), significance."""
    r = F.max(F.when(F.col("significance") >= 2, F.abs("r")))
    return peaks.groupBy("target_id").agg(r.alias("r")).withColumn("r_out", start + space * F.greatest(F.lit(0.0), F.rint((F.col("r") - start) / space)))


def label_components(fits: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Adds label: approaching or receding, by the sign of velocity against that of the outermost point on the signed axis; ambiguous ones flagged."""
    w = Window.partitionBy(*keys).orderBy(F.abs("s").desc(), "bin_id")
    outer = F.signum(F.first("v").over(w) * F.first("s").over(w))
    side = F.signum(F.col("v") * F.col("s")) * outer
    return fits.withColumn("label", F.when(side > 0, "disk").when(side < 0, "counter").otherwise("ambiguous"))


def score_trials(trials: DataFrame, members: DataFrame, states: DataFrame, va: Sequence[float], vb: Sequence[float]) -> DataFrame:
    """Per trial the summed chi2 over bins: member velocities, weighted bin means, then the states bilinearly at (v_a, v_b).

    `trials`: target_id, trial, pa, incl, vsys_a, vsys_b, nodes; `members`: target_id, bin_id, x, y, weight;
    `states` holds every (ia, ib, jf). The least chi2 over the fraction axis is taken before
    interpolating; a bin off the grid makes the trial's score NULL.
    """
    rows = members.join(small_side(trials), "target_id")  # one round's proposals
    v = {c: projected_velocity("x", "y", "pa", "incl", f"vsys_{c}", "nodes") for c in "ab"}
    w = F.col("weight")
    mean = lambda c: (F.sum(w * v[c]) / F.sum(w)).alias(f"v_{c}")
    bins = rows.groupBy("target_id", "trial", "bin_id").agg(mean("a"), mean("b"))
    at = lambda c, axis: (F.col(c) - axis[0]) / (axis[1] - axis[0])
    bins = bins.withColumns({"pa_": at("v_a", va), "pb_": at("v_b", vb)})
    fa, fb = F.floor("pa_"), F.floor("pb_")
    corner = lambda i, j: F.struct((fa + i).cast("int").alias("ia"), (fb + j).cast("int").alias("ib"), ((1 - F.abs(F.col("pa_") - fa - i)) * (1 - F.abs(F.col("pb_") - fb - j))).alias("w"))
    corners = bins.select("target_id", "trial", "bin_id", F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)]))).where("w > 0")
    surface = states.where(clean("chi2").isNotNull()).groupBy("target_id", "bin_id", "ia", "ib").agg(F.min("chi2").alias("chi2"))
    got = corners.join(surface, ["target_id", "bin_id", "ia", "ib"], "left").groupBy("target_id", "trial", "bin_id").agg(
        F.when(F.count("*") == F.count("chi2"), F.sum(F.col("w") * F.col("chi2"))).alias("chi2")
    )
    return got.groupBy("target_id", "trial").agg(F.when(F.count("*") == F.count("chi2"), F.sum("chi2")).alias("score"), F.count("*").alias("n_bins"))


def ring_coverage(points: DataFrame, space: float, sectors: int = 8, keys: Sequence[str] = ("target_id",), least: float = 0.5) -> DataFrame:
    """Per ring: points, azimuth sectors hit, and a flag where too few are. `points`: keys, r, theta."""
    ring = F.floor(F.col("r") / space).cast("int")
    sector = F.floor(F.pmod(F.col("theta"), F.lit(2 * 3.141592653589793)) / (2 * 3.141592653589793 / sectors)).cast("int")
    found = points.groupBy(*keys, ring.alias("ring")).agg(F.count("*").alias("n"), F.countDistinct(sector).alias("n_sectors"))
    return found.withColumn("coverage", F.col("n_sectors") / sectors).withColumn("poor", F.col("coverage") < least)


def centroid_vs_integrated(members: DataFrame, velocity: Column, keys: Sequence[str] = BIN) -> DataFrame:
    """Weighted mean of member velocities minus the velocity at the weighted centroid. `velocity` is in terms of x and y."""
    w = F.col("weight")
    sums = members.withColumn("v", velocity).groupBy(*keys).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("mean"), (F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))
    return sums.withColumn("at_centroid", velocity).select(*keys, "mean", "at_centroid", (F.col("mean") - F.col("at_centroid")).alias("difference"))


def difference_of(a: DataFrame, b: DataFrame, values: Sequence[str], keys: Sequence[str] = BIN) -> DataFrame:
    """a - b of each value over the common domain: two models, propagated against anchored, coarse against fine."""
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values])
    return a.select(*keys, *values).join(right, list(keys)).select(*keys, *[(F.col(v) - F.col(f"b_{v}")).alias(f"d_{v}") for v in values])


def fine_fractions(best: DataFrame, reach: float = 0.1, step: float = 0.01) -> DataFrame:
    """Adds i_f and f: a finer grid around each bin's best fraction, inside (0, 1)."""
    n = round(reach / step)
    grid = F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda k: F.round(F.col("f") + k * step, 12))
    return best.withColumn("grid", F.filter(grid, lambda v: (v > 0) & (v < 1))).select(*[c for c in best.columns if c != "f"], F.posexplode("grid").alias("i_f", "f"))


def on_fraction_edge(best: DataFrame, fractions: DataFrame, keys: Sequence[str] = BIN) -> DataFrame:
    """The bins whose best fraction is at an end of its own grid: these widen the grid."""
    ends = fractions.groupBy(*keys).agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    return best.join(ends, list(keys)).where((F.col("f") <= F.col("lo")) | (F.col("f") >= F.col("hi")))


def anchor_cell(states: DataFrame, wanted: DataFrame, keys: Sequence[str] = BIN) -> DataFrame:
    """The cell nearest to the wanted velocities (wa, wb, one row per key), and there the least chi2 over the fractions."""
    d = F.pow(F.col("va") - F.col("wa"), 2) + F.pow(F.col("vb") - F.col("wb"), 2)
    rows = states.where(clean("chi2").isNotNull()).join(wanted, list(keys)).withColumn("d", d)
    best = F.min(F.struct("d", "ia", "ib", "chi2", "jf")).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.ia", "best.ib", "best.jf", "best.chi2")


def basin_weights(states: DataFrame, keys: Sequence[str] = BIN, axes: Sequence[str] = AXES) -> DataFrame:
    """Every cell with its basin's minimum, delta from it, and weights normalised in the basin."""
    keys = list(keys)
    found = basins(states, keys, axes)
    ends = [f"m_{a}" for a in axes]
    least = found.groupBy(*keys, *ends).agg(F.min("chi2").alias("least"))
    rows = found.join(least, [*keys, *ends]).withColumn("delta", F.col("chi2") - F.col("least")).withColumn("weight", relative_likelihood("delta")).drop("least")
    return P.normalize_weights(rows, [*keys, *ends])


def selected_vs_global(selected: DataFrame, weighted: DataFrame, keys: Sequence[str] = BIN, axes: Sequence[str] = AXES) -> DataFrame:
    """delta chi2 of a selected cell to its basin's minimum and to the surface's."""
    keys = list(keys)
    whole = weighted.groupBy(*keys).agg(F.min("chi2").alias("least"))
    return selected.select(*keys, *axes).join(weighted.select(*keys, *axes, "chi2", "delta"), [*keys, *axes]).join(whole, keys).select(*keys, F.col("delta").alias("to_basin"), (F.col("chi2") - F.col("least")).alias("to_global"))


def strata(rows: DataFrame, edges: dict[str, Sequence[float]]) -> DataFrame:
    """Adds s_<name>: the number of edges at or below the value."""
    for name, cuts in edges.items():
        rows = rows.withColumn(f"s_{name}", sum((F.col(name) >= c).cast("int") for c in cuts))
    return rows


def population_summary(weights: DataFrame, meta: DataFrame, keys: Sequence[str] = (*BIN, "component")) -> DataFrame:
    """Light-weighted log age and metallicity, stars only, with the share of weight at the edges of the template grid."""
    edges = meta.agg(F.min("log_age").alias("a0"), F.max("log_age").alias("a1"), F.min("metal").alias("m0"), F.max("metal").alias("m1"))
    table = small_side(meta.crossJoin(F.broadcast(edges)))
    rows = weights.join(table, "template_id").where(~F.coalesce("is_gas", F.lit(False)) & (F.col("weight") > 0))
    w, edge = F.col("weight"), F.col("log_age").isin(F.col("a0"), F.col("a1")) | F.col("metal").isin(F.col("m0"), F.col("m1"))
    return rows.groupBy(*keys).agg((F.sum(w * F.col("log_age")) / F.sum(w)).alias("log_age"), (F.sum(w * F.col("metal")) / F.sum(w)).alias("metal"), F.sum(w).alias("light"), (F.sum(F.when(edge, w).otherwise(0.0)) / F.sum(w)).alias("edge_fraction"))


def joint_minimum(a: DataFrame, b: DataFrame, keys: Sequence[str] = BIN, axes: Sequence[str] = AXES) -> DataFrame:
    """Cells of both surfaces with J = delta_a + delta_b, and whether J is the least of its key (ties to the first cell)."""
    keys = list(keys)
    da, db = S.delta_chi2(a, keys).withColumnRenamed("delta", "da"), S.delta_chi2(b, keys).withColumnRenamed("delta", "db")
    rows = da.select(*keys, *axes, "da").join(db.select(*keys, *axes, "db"), [*keys, *axes]).withColumn("j", F.col("da") + F.col("db"))
    best = rows.where("j is not null").groupBy(*keys).agg(F.min(F.struct("j", *axes)).alias("best"))
    return rows.join(best, keys).withColumn("is_best", F.struct("j", *axes) == F.col("best")).drop("best")


def direct_or_sampled(weighted: DataFrame, n_draws: int, limit: int = 200, seed: int = 0, keys: Sequence[str] = BIN, cell: str = "cell") -> DataFrame:
    """Cells to evaluate once each, with multiplicity: all cells of small surfaces, distinct draws of large ones."""
    keys = list(keys)
    sizes = weighted.where("p > 0").groupBy(*keys).agg(F.count("*").alias("n_cells"))
    rows = weighted.where("p > 0").join(sizes, keys)
    direct = rows.where(F.col("n_cells") <= limit).select(*keys, cell, F.lit(1).cast("long").alias("multiplicity"), F.col("p").alias("weight"))
    drawn = P.draw_states(rows.where(F.col("n_cells") > limit), n_draws, seed, keys, cell).groupBy(*keys, cell).agg(F.count("*").alias("multiplicity"))
    return direct.unionByName(drawn.withColumn("weight", F.col("multiplicity") / n_draws))


def reweight(evaluated: DataFrame, other: DataFrame, keys: Sequence[str] = BIN, cell: str = "cell") -> DataFrame:
    """Drawn cells take only the other arm's likelihood; directly evaluated ones multiply it with their own weight."""
    keys = list(keys)
    rows = evaluated.join(S.delta_chi2(other, keys).select(*keys, cell, "delta"), [*keys, cell])
    return P.normalize_weights(rows.withColumn("weight", F.col("weight") * relative_likelihood("delta")), keys)


def contrasts(solutions: DataFrame, quantiles: Sequence[float] = (0.16, 0.5, 0.84), keys: Sequence[str] = BIN) -> DataFrame:
    """Weighted quantiles of the differences in age and metallicity between both components of each solution."""
    rows = solutions.withColumns({"d_age": F.col("log_age_a") - F.col("log_age_b"), "d_metal": F.col("metal_a") - F.col("metal_b")})
    parts = [P.weighted_quantiles(rows, quantiles, keys, x, "weight", tie=("solution",)).withColumn("quantity", F.lit(x)) for x in ("d_age", "d_metal")]
    return parts[0].unionByName(parts[1])


def mc_summary(rows: DataFrame, keys: Sequence[str] = BIN, value="value") -> DataFrame:
    """Percentiles per quantity and layer of uncertainty; the layers are never pooled."""
    return A.group_interval(rows, [*keys, "quantity", "layer"], value)


def radial_profile(points: DataFrame, space: float, pa: float, incl: float, keys: Sequence[str] = ("target_id",), value="value") -> DataFrame:
    r, _ = deproject("x", "y", F.lit(pa), F.lit(incl))
    return A.group_interval(points.withColumn("ring", F.floor(r / space).cast("int")), [*keys, "ring"], value)


def match_basins(coarse: DataFrame, fine: DataFrame, factor: int, keys: Sequence[str] = BIN, axes: Sequence[str] = AXES) -> DataFrame:
    """(keys, c_<axis>, f_<axis>, n, matched): coarse and fine minima whose basins share cells, and how many fine cells they share.

    A fine cell lies in the coarse cell `factor` times as wide, and so in its basin. A pair is
    matched where each minimum is the other's largest partner; ties go to the lower minimum in grid order.
    """
    keys = list(keys)
    a = basins(coarse, keys, axes).select(*keys, *axes, *[F.col(f"m_{x}").alias(f"c_{x}") for x in axes])
    b = basins(fine, keys, axes).select(*keys, *[F.floor(F.col(x) / factor).cast("int").alias(x) for x in axes], *[F.col(f"m_{x}").alias(f"f_{x}") for x in axes])
    c, f = [f"c_{x}" for x in axes], [f"f_{x}" for x in axes]
    shared = materialize(a.join(b, [*keys, *axes]).groupBy(*keys, *c, *f).agg(F.count("*").alias("n")), "shared-basins")
    best = lambda own, other: shared.groupBy(*keys, *own).agg(F.min(F.struct((-F.col("n")).alias("n"), *other)).alias("b")).select(*keys, *own, *[F.col(f"b.{x}").alias(x) for x in other])
    mutual = best(c, f).join(best(f, c), [*keys, *c, *f]).withColumn("matched", F.lit(True))
    return shared.join(mutual, [*keys, *c, *f], "left").fillna(False, ["matched"])


def grid_resolution_compare(coarse: DataFrame, fine: DataFrame, factor: int, keys: Sequence[str] = BIN, axes: Sequence[str] = AXES) -> DataFrame:
    """Per key: basins on both grids, how many are matched, coarse basins over several fine ones, and the share of cells in matched basins."""
    keys = list(keys)
    pairs = match_basins(coarse, fine, factor, keys, axes)
    c, f = F.struct(*[f"c_{x}" for x in axes]), F.struct(*[f"f_{x}" for x in axes])
    several = pairs.groupBy(*keys, c.alias("c")).agg(F.count("*").alias("k")).groupBy(*keys).agg(F.count_if(F.col("k") > 1).alias("n_split"))
    whole = pairs.groupBy(*keys).agg(
        F.count_distinct(c).alias("n_coarse"), F.count_distinct(f).alias("n_fine"), F.count_if("matched").alias("n_matched"), (F.sum(F.when(F.col("matched"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement")
    )
    return whole.join(several, keys)


def robustness_summary(rows: DataFrame, variants: Sequence[str], baseline: str, keys: Sequence[str] = ("target_id", "quantity")) -> DataFrame:
    """Shift of each conclusion under each alternative setting."""
    wide = rows.groupBy(*keys).pivot("variant", [baseline, *variants]).agg(F.first("value"))
    return wide.select(*keys, *[(F.col(f"`{v}`") - F.col(f"`{baseline}`")).alias(f"shift_{v}") for v in variants])


def final_table(bins: DataFrame, *parts: DataFrame, keys: Sequence[str] = BIN) -> DataFrame:
    """One wide row per bin: the parts are joined on the bin, columns that are there already are left out."""
    for part in parts:
        new = [c for c in part.columns if c not in bins.columns]
        bins = bins.join(part.select(*keys, *new), list(keys), "left")
    return bins
