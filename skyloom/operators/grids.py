"""Surfaces over discrete state grids: neighbours, descent, basins, and profile likelihoods by moments."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean
from skyloom.sources.scratch import materialize

AXES = ("ia", "ib", "jf")
#: Templates of a block and bins of a share: what meets in one task.
BLOCK_NODES, SHARE_BINS = 64, 128


def offsets(spark: SparkSession, axes: Sequence[str] = AXES, faces_only: bool = False) -> DataFrame:
    steps = [s for s in product((-1, 0, 1), repeat=len(axes)) if any(s) and (not faces_only or sum(map(abs, s)) == 1)]
    return F.broadcast(spark.createDataFrame(steps, ", ".join(f"d_{a} int" for a in axes)))


def neighbor_pairs(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), axes: Sequence[str] = AXES, faces_only: bool = False, value: str = "chi2") -> DataFrame:
    """Each finite cell with its finite neighbours (n_<axis>, n_<value>); an offset table is broadcast, never the grid."""
    cells = states.select(*keys, *axes, clean(value).alias(value)).where(F.col(value).isNotNull())
    moved = cells.crossJoin(offsets(states.sparkSession, axes, faces_only))  # a fixed table of at most 26 rows
    moved = moved.select(*keys, *axes, value, *[(F.col(a) + F.col(f"d_{a}")).alias(f"n_{a}") for a in axes])
    other = cells.select(*keys, *[F.col(a).alias(f"n_{a}") for a in axes], F.col(value).alias(f"n_{value}"))
    return moved.join(other, [*keys, *[f"n_{a}" for a in axes]])


def next_cells(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), axes: Sequence[str] = AXES, faces_only: bool = False, value: str = "chi2") -> DataFrame:
    """The next cell of steepest descent: the least of a cell and its neighbours, ties to the lowest index."""
    pairs = neighbor_pairs(states, keys, axes, faces_only, value)
    best = pairs.groupBy(*keys, *axes).agg(F.min(F.struct(f"n_{value}", *[f"n_{a}" for a in axes])).alias("best"))
    cells = states.select(*keys, *axes, clean(value).alias(value)).where(F.col(value).isNotNull())
    down = F.col(f"best.n_{value}") < F.col(value)
    joined = cells.join(best, [*keys, *axes], "left")
    return joined.select(*keys, *axes, value, *[F.when(down, F.col(f"best.n_{a}")).otherwise(F.col(a)).cast("int").alias(f"m_{a}") for a in axes])


def basins(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), axes: Sequence[str] = AXES, faces_only: bool = False, value: str = "chi2", max_rounds: int = 32) -> DataFrame:
    """Every finite cell with the minimum that it descends to (m_<axis>), by pointer doubling."""
    now = materialize(next_cells(states, keys, axes, faces_only, value), "basins")
    for _ in range(max_rounds):
        then = now.select(*keys, *[F.col(a).alias(f"m_{a}") for a in axes], *[F.col(f"m_{a}").alias(f"t_{a}") for a in axes])
        moved = now.join(then, [*keys, *[f"m_{a}" for a in axes]])
        changed = None
        for a in axes:
            c = F.col(f"m_{a}") != F.col(f"t_{a}")
            changed = c if changed is None else changed | c
        stepped = materialize(moved.select(*keys, *axes, value, *[F.col(f"t_{a}").alias(f"m_{a}") for a in axes], changed.alias("moved")), "basins")
        now = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return now
    raise RuntimeError(f"descent did not end in {max_rounds} rounds")


def basin_mask(found: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), axes: Sequence[str] = AXES) -> DataFrame:
    """The cells that share their minimum with the key's anchor cell."""
    ends = found.join(anchors.select(*keys, *axes), [*keys, *axes]).select(*keys, *[f"m_{a}" for a in axes])
    return found.join(ends, [*keys, *[f"m_{a}" for a in axes]], "left_semi")


def packed(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row a key: pix and the fields as arrays in the same order. A spectrum is bounded by its instrument."""
    items = rows.groupBy(*keys).agg(F.collect_list(F.struct("pix", *fields)).alias("items"))
    return items.select(*keys, *[F.col(f"items.{c}").alias(c) for c in ("pix", *fields)])


def template_moments(spectra: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), *, pairs: bool = False) -> DataFrame:
    """Moments over each bin's good pixels for every template (node), or with `pairs` for every pair a <= b of them.

    (keys, s, n_pix, node, d, m) or (keys, s, n_pix, a, b, da, db, maa, mab, mbb), where s = sum
    d^2 / s^2, d and m the products of model and data and of two models; pixels that a model lacks
    are 0 to it. `spectra`: keys, pix, flux, unc; `nodes`: node, pix, model.

    Spectra and models are rows of arrays. Bins are dealt into shares and nodes into blocks; a task
    gets a share with one block, or two of them, and multiplies matrices. No pixel meets a pair of nodes as a row.
    """
    keys = list(keys)
    data = spectra.select(*keys, "pix", clean("flux").alias("flux"), (1.0 / (F.col("unc") * F.col("unc"))).alias("w")).where("flux is not null and w is not null")
    data = materialize(packed(data, keys, ("flux", "w")), "grid-spectra")
    models = materialize(packed(nodes.select("node", "pix", clean("model").alias("model")).where("model is not null"), ["node"], ("model",)), "grid-nodes")
    n_blocks, n_shares = max(1, -(-models.count() // BLOCK_NODES)), max(1, -(-data.count() // SHARE_BINS))
    models = models.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(n_blocks)))
    tasks = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in range(n_blocks) for b in range(a, n_blocks) if pairs or a == b)]
    number = F.explode(F.sequence(F.lit(0), F.lit(len(tasks) - 1)))
    left = data.withColumn("share", F.pmod(F.xxhash64(*keys), F.lit(n_shares))).withColumn("task", number)
    of_block = data.sparkSession.createDataFrame([(block, i, a, b) for i, a, b in tasks for block in {a, b}], "block long, task int, a_block long, b_block long")
    right = models.join(of_block, "block").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shares - 1).cast("long"))))
    kind = dict(nodes.dtypes)["node"]
    shape = ", ".join(f"`{k}` {dict(spectra.dtypes)[k]}" for k in keys) + ", s double, n_pix long, "
    shape += f"a {kind}, b {kind}, da double, db double, maa double, mab double, mbb double" if pairs else f"node {kind}, d double, m double"

    def multiply(bins: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(bins) or not len(found):
            return pd.DataFrame(columns=[*keys, "s", "n_pix", *(("a", "b", "da", "db", "maa", "mab", "mbb") if pairs else ("node", "d", "m"))])
        found = found.sort_values("node")
        low = min(min(p.min() for p in bins["pix"]), min(p.min() for p in found["pix"]))
        size = max(max(p.max() for p in bins["pix"]), max(p.max() for p in found["pix"])) - low + 1
        matrix = np.zeros((len(found), size))
        for row, pix, model in zip(matrix, found["pix"], found["model"]):
            row[pix - low] = model
        node, block = found["node"].to_numpy(), found["block"].to_numpy()
        a, b = np.triu_indices(len(node))  # nodes in order, so a <= b
        if found["a_block"].iloc[0] != found["b_block"].iloc[0]:
            across = block[a] != block[b]  # pairs within a block are another task's
            a, b = a[across], b[across]
        parts = []
        for _, row in bins.iterrows():
            w, f = np.zeros(size), np.zeros(size)
            w[row["pix"] - low], f[row["pix"] - low] = row["w"], row["flux"]
            d, m = matrix @ (w * f), (matrix * matrix) @ w
            if pairs:
                products = (matrix * w) @ matrix.T
                columns = {"a": node[a], "b": node[b], "da": d[a], "db": d[b], "maa": m[a], "mab": products[a, b], "mbb": m[b]}
            else:
                columns = {"node": node, "d": d, "m": m}
            parts.append(pd.DataFrame({k: row[k] for k in keys} | {"s": float(w @ (f * f)), "n_pix": len(row["pix"])} | columns))
        return pd.concat(parts)

    return left.groupBy("task", "share").cogroup(right.groupBy("task", "share")).applyInPandas(multiply, shape)


def two_component_chi2(s, da, db, maa, mab, mbb, f) -> Column:
    """chi2 of the best amplitude (not negative) of f A + (1 - f) B."""
    d = f * da + (1 - f) * db
    m = f * f * maa + 2 * f * (1 - f) * mab + (1 - f) * (1 - f) * mbb
    up = F.greatest(d, F.lit(0.0))
    return s - F.try_divide(up * up, m)


def two_component_grid(spectra: DataFrame, nodes: DataFrame, fractions: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """chi2 of every (node a, node b, fraction) state of every bin; status 1 where there is no value."""
    keys = list(keys)
    one = F.struct("a", "b", "da", "db", "maa", "mbb")
    other = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("db").alias("da"), F.col("da").alias("db"), F.col("mbb").alias("maa"), F.col("maa").alias("mbb"))
    orders = F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other))
    states = template_moments(spectra, nodes, keys, pairs=True).select(*keys, "s", "n_pix", "mab", F.inline(orders)).crossJoin(F.broadcast(fractions))  # the fractions are a parameter
    chi2 = clean(two_component_chi2(F.col("s"), F.col("da"), F.col("db"), F.col("maa"), F.col("mab"), F.col("mbb"), F.col("f")))
    return states.select(*keys, "a", "b", "i_f", "f", chi2.alias("chi2"), F.when(chi2.isNull(), 1).otherwise(0).alias("status"), "n_pix")


def node_fits(spectra: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, chi2, amplitude, n_pix) of every single template, NULL where it has no pixel in common with the bin."""
    up = F.greatest(F.col("d"), F.lit(0.0))
    found = template_moments(spectra, nodes, keys)
    return found.select(*keys, "node", clean(F.col("s") - F.try_divide(up * up, F.col("m"))).alias("chi2"), F.try_divide(up, F.col("m")).alias("amplitude"), "n_pix")


def one_component_fit(spectra: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """The best single node per bin, ties to the lowest: node, chi2, amplitude, n_pix."""
    keys = list(keys)
    best = F.min(F.struct("chi2", "node", "amplitude", "n_pix")).alias("best")
    return node_fits(spectra, nodes, keys).where("chi2 is not null").groupBy(*keys).agg(best).select(*keys, "best.node", "best.chi2", "best.amplitude", "best.n_pix")


def velocity_bounds(velocities: Sequence[float], margin: float) -> tuple[float, float]:
    """Where a single component is looked for: the grid's velocities and a margin beyond either end."""
    return min(velocities) - margin, max(velocities) + margin


def single_fit(spectra: DataFrame, nodes: DataFrame, axes: DataFrame, bounds: tuple[float, float], keys: Sequence[str] = ("target_id", "bin_id")) -> tuple[DataFrame, DataFrame]:
    """(best, profile): one component per bin over velocity, dispersion and template.

    `axes`: node, velocity, sigma, template, a row a node; nodes beyond the bounds take no part.
    best: keys, velocity, sigma, template, chi2, amplitude, n_pix, at_bound, success, a row for every
    bin, NULL without success; success wants a finite chi2 with a positive amplitude. profile: for
    each velocity the least chi2 over the other two axes and where it is. Ties go to the lowest
    velocity, dispersion and template.
    """
    keys = list(keys)
    within = axes.where(F.col("velocity").between(*bounds)).select("node", "velocity", "sigma", "template")
    used = nodes.join(within.select("node"), "node", "left_semi")
    fits = node_fits(spectra, used, keys).where("chi2 is not null and amplitude > 0").join(within, "node")
    at = F.struct("sigma", "template", "amplitude", "n_pix")
    profile = fits.groupBy(*keys, "velocity").agg(F.min("chi2").alias("chi2"), F.min_by(at, F.struct("chi2", "sigma", "template")).alias("at"))
    profile = materialize(profile.select(*keys, "velocity", "chi2", "at.*"), "single-profile")
    best = profile.groupBy(*keys).agg(F.min_by(F.struct("velocity", "sigma", "template", "chi2", "amplitude", "n_pix"), F.struct("chi2", "velocity", "sigma", "template")).alias("best"), F.min("velocity").alias("first"), F.max("velocity").alias("last"))
    edge = (F.col("best.velocity") == F.col("first")) | (F.col("best.velocity") == F.col("last"))
    best = best.select(*keys, "best.*", edge.alias("at_bound"))
    every = spectra.select(*keys).distinct().join(best, keys, "left")
    return every.withColumn("success", F.col("chi2").isNotNull()), profile


def corner_states(spectra: DataFrame, nodes: DataFrame, axes: DataFrame, fraction: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """(keys, va, vb, chi2) of the four states at the corners of the velocity plane, NULL where one fails.

    The corners take the lowest dispersion and template of the lowest and the highest velocity; `fraction`: i_f, f, one row.
    """
    keys = list(keys)
    least = F.struct("velocity", "sigma", "template", "node")
    most = F.struct((-F.col("velocity")).alias("v"), "sigma", "template", "velocity", "node")
    ends = axes.agg(F.min(least).alias("a"), F.min(most).alias("b"))
    ends = ends.select(F.explode(F.array(F.struct("a.node", "a.velocity"), F.struct("b.node", "b.velocity"))).alias("x")).select("x.*").distinct()
    found = two_component_grid(spectra, nodes.join(ends.select("node"), "node", "left_semi"), fraction, keys)
    for side, name in (("a", "va"), ("b", "vb")):
        found = found.join(ends.select(F.col("node").alias(side), F.col("velocity").alias(name)), side)
    return found.select(*keys, "va", "vb", "chi2")


def best_state_refit(grid: DataFrame, spectra: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """The best state of each bin with its amplitude, recomputed residual chi2 and fraction."""
    keys = list(keys)
    best = F.min(F.struct("chi2", "a", "b", "i_f", "f")).alias("best")
    chosen = grid.where("chi2 is not null").groupBy(*keys).agg(best).select(*keys, "best.*")
    pix = chosen.join(spectra, keys).join(nodes.select("pix", F.col("node").alias("a"), F.col("model").alias("ma")), ["pix", "a"]).join(nodes.select("pix", F.col("node").alias("b"), F.col("model").alias("mb")), ["pix", "b"])
    mix, w = F.col("f") * F.col("ma") + (1 - F.col("f")) * F.col("mb"), 1.0 / (F.col("unc") * F.col("unc"))
    sums = pix.withColumn("mix", mix).groupBy(*keys, "chi2", "a", "b", "f").agg(F.sum(w * F.col("flux") * F.col("mix")).alias("d"), F.sum(w * F.col("mix") * F.col("mix")).alias("m"), F.sum(w * F.col("flux") * F.col("flux")).alias("s"))
    amplitude = F.try_divide(F.greatest(F.col("d"), F.lit(0.0)), F.col("m"))
    again = F.col("s") - 2 * amplitude * F.col("d") + amplitude * amplitude * F.col("m")
    return sums.select(*keys, "a", "b", "f", "chi2", amplitude.alias("amplitude"), again.alias("chi2_again"))


def state_summary(states: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """Failures by status, boundary hits, the first failure in grid order and the best index."""
    failed = F.col("status") != 0
    return states.groupBy(*keys).agg(
        F.count("*").alias("n_states"), F.count_if(failed).alias("n_failures"), F.count_if(F.col("status") == 1).alias("n_fit_failures"), F.count_if(F.col("status") == 2).alias("n_mismatches"),
        F.count_if("boundary").alias("n_boundary"), F.min(F.when(failed, F.struct(*AXES))).alias("first_failure"), F.min(F.when(clean("chi2").isNotNull(), F.struct("chi2", *AXES))).alias("best"),
    )
