"""Grouped statistics: robust collapses, coadds, signal to noise, weights, calibration summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean, col, noise_factor
from skyloom.operators.filters import rest_window, valid_sample
from skyloom.operators.ranking import exact_percentiles, prefix_sums
from skyloom.sources.scratch import materialize, small_side

MAD_TO_SIGMA = 1.4826


def median(value) -> Column:
    """Exact, interpolated, skipping NULL."""
    return F.percentile(col(value), F.lit(0.5))


def collapse(samples: DataFrame, keys: Sequence[str] = ("target_id", "arm", "y", "x"), statistic: str = "median", good="good") -> DataFrame:
    if statistic not in ("median", "mean"):
        raise ValueError(f"unknown statistic {statistic!r}")
    v = F.when(col(good), clean("flux"))
    return samples.groupBy(*keys).agg((median(v) if statistic == "median" else F.avg(v)).alias("value"))


def array_median(values) -> Column:
    """Median of an array column without any shuffle; NULLs are skipped."""
    v = F.array_sort(F.filter(col(values), lambda x: x.isNotNull()))
    n = F.size(v)
    return F.when(n > 0, (F.element_at(v, F.floor((n + 1) / 2).cast("int")) + F.element_at(v, (F.floor(n / 2) + 1).cast("int"))) / 2)


def continuum_window(samples: DataFrame, low: float, high: float, z: float = 0.0, min_valid: float = 0.5, keys: Sequence[str] = ("target_id", "arm", "y", "x"), good_spaxel=None) -> DataFrame:
    """Median flux and root median variance per spaxel over the window's good channels."""
    rows = samples.where(rest_window("wave", low, high, z) & F.col("good_wave"))
    ok = valid_sample("flux", "unc", "good")
    found = rows.groupBy(*keys).agg(
        F.avg(ok.cast("int")).alias("valid_fraction"), median(F.when(ok, F.col("flux"))).alias("signal"),
        F.sqrt(median(F.when(ok, F.col("unc") * F.col("unc")))).alias("noise"), F.count("*").alias("n_channels"),
        *([F.max(col(good_spaxel)).alias("spaxel_ok")] if good_spaxel is not None else []),
    )
    kept = (F.col("valid_fraction") >= min_valid) & (F.col("noise") > 0) & (F.col("n_channels") >= 2)
    kept = kept if good_spaxel is None else kept & F.col("spaxel_ok")
    kept = F.coalesce(kept, F.lit(False))
    return found.select(*keys, "valid_fraction", F.when(kept, F.col("signal")).alias("signal"), F.when(kept, F.col("noise")).alias("noise"), kept.alias("valid"))


def coadd_bins(
    samples: DataFrame, membership: DataFrame, *, pixel_area: Column | float = 1.0, min_members: float = 0.5, keys: Sequence[str] = ("target_id", "arm"),
    pixel: Sequence[str] = ("y", "x"), broadcast_rows: int = 200_000,
) -> DataFrame:
    """Aperture sums per (bin, channel). `samples`: flux, unc, good; `membership`: keys, pixel, bin_id."""
    keys, pixel = list(keys), list(pixel)
    sizes = membership.groupBy(*keys, "bin_id").agg(F.count("*").alias("n_members"))
    m = membership.select(*keys, *pixel, "bin_id")
    if m.count() <= broadcast_rows:
        m = F.broadcast(m)
    ok = valid_sample("flux", "unc", "good")
    scale = col(pixel_area)
    sums = (
        samples.join(m, [*keys, *pixel])
        .groupBy(*keys, "bin_id", "chan")
        .agg(
            F.count_if(ok).alias("n_contrib"), F.sum(F.when(ok, F.col("flux") * scale)).alias("sum_flux"),
            F.sum(F.when(ok, F.col("unc") * F.col("unc") * scale * scale)).alias("sum_var"), F.max("wave").alias("wave"),
        )
    )
    needed = F.greatest(F.lit(1), F.ceil(min_members * F.col("n_members")))
    enough = F.col("n_contrib") >= needed
    return sums.join(sizes, [*keys, "bin_id"]).select(
        *keys, "bin_id", "chan", "wave", F.when(enough, F.col("sum_flux")).alias("flux"), F.when(enough, F.sqrt("sum_var")).alias("unc"),
        enough.alias("good"), "n_contrib", "n_members",
    )


def achieved_sn(
    spectra: DataFrame, low: float, high: float, z: float = 0.0, *, min_channels: int = 5, require_positive: bool = True, keys: Sequence[str] = ("target_id", "arm", "bin_id")
) -> DataFrame:
    """Signal to noise per bin from the window's valid channels; every bin of the input has a row."""
    if min_channels < 2:
        raise ValueError("min_channels must be two at least")
    ok = rest_window("wave", low, high, z) & valid_sample("flux", "unc", "good")
    f, u = F.when(ok, F.col("flux")), F.when(ok, F.col("unc"))
    found = spectra.groupBy(*keys).agg(
        F.count_if(ok).alias("n_good"), median(f).alias("median_flux"), F.percentile(u, F.array(F.lit(0.05), F.lit(0.5))).alias("u"), F.min(u).alias("min_unc"),
        F.avg(F.when(ok, (F.col("flux") < 0).cast("int"))).alias("negative_fraction"), median(f / u).alias("legacy"),
    )
    enough = F.col("n_good") >= min_channels
    found = found.withColumn("median_unc", F.col("u")[1]).withColumn("p05_unc", F.col("u")[0])
    values = {c: F.when(enough, F.col(c)) for c in ("median_flux", "median_unc", "min_unc", "p05_unc", "negative_fraction", "legacy")}
    signed = F.when(enough & (F.col("median_unc") > 0), F.col("median_flux") / F.col("median_unc"))
    positive = F.coalesce(enough & (F.col("median_flux") > 0), F.lit(False))
    sn = F.when(positive, signed) if require_positive else signed
    return found.select(*keys, "n_good", *[v.alias(c) for c, v in values.items()], signed.alias("signed"), positive.alias("positive"), sn.alias("sn"))


Law = Callable[[Column, Column, Column], Column]


def summed_sn(mode: str = "none", alpha: float = 0.0) -> Law:
    """The usual law: sum of signals over the root of summed squared noise, corrected for the bin's size."""
    return lambda s, n2, n: F.when((n > 0) & (n2 > 0), s / (F.sqrt(n2) * noise_factor(n, mode, alpha))).otherwise(0.0)


def bin_capacity(members: DataFrame, keys: Sequence[str] = ("target_id", "arm", "bin_id"), law: Law | None = None, signal="signal", noise="noise") -> DataFrame:
    """Per bin npix, sn and capacity = max(sn, 0)^2. `law` takes (sum of signal, sum of noise^2, n)."""
    law = law or summed_sn()
    sums = members.groupBy(*keys).agg(F.sum(col(signal)).alias("s"), F.sum(col(noise) * col(noise)).alias("n2"), F.count("*").alias("npix"))
    return sums.withColumn("sn", law(F.col("s"), F.col("n2"), F.col("npix"))).select(*keys, "npix", "sn", F.pow(F.greatest("sn", F.lit(0.0)), 2).alias("capacity"))


def capacity_scatter(bins: DataFrame, target: float, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    """Percent scatter of the capacities of bins with more than one pixel."""
    relative = F.when(F.col("npix") > 1, F.pow((F.col("capacity") - target) / target, 2))
    return bins.groupBy(*keys).agg((100.0 * F.sqrt(F.avg(relative))).alias("scatter"), F.count_if(F.col("npix") == 1).alias("n_single"), F.count("*").alias("n_bins"))


def light_weights(members: DataFrame, keys: Sequence[str] = ("target_id", "arm", "bin_id"), signal="signal") -> DataFrame:
    """Adds weight: clipped signal normalised per bin, equal weights where there is none.

    Sums are aggregated and joined back, so a bin of any size is split between tasks.
    """
    keys = list(keys)
    v = F.greatest(F.coalesce(clean(signal), F.lit(0.0)), F.lit(0.0))
    totals = members.groupBy(*keys).agg(F.sum(v).alias("total_light"), F.count("*").alias("total_rows"))
    rows = members.join(totals, keys)
    return rows.withColumn("weight", F.when(F.col("total_light") > 0, v / F.col("total_light")).otherwise(1.0 / F.col("total_rows"))).drop("total_light", "total_rows")


def bin_centroids(members: DataFrame, keys: Sequence[str] = ("target_id", "arm", "bin_id"), x="x", y="y", weight="weight") -> DataFrame:
    w = F.when(col(weight) > 0, col(weight))
    total = F.sum(w)
    return members.groupBy(*keys).agg(
        F.count("*").alias("npix"), F.avg(col(x)).alias("x_mean"), F.avg(col(y)).alias("y_mean"), F.try_divide(F.sum(w * col(x)), total).alias("x_light"), F.try_divide(F.sum(w * col(y)), total).alias("y_light")
    )


def bin_geometry(members_a: DataFrame, members_b: DataFrame, pixel_area: float, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    a = members_a.groupBy(*keys).agg(F.count("*").alias("n_a"))
    b = members_b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    return a.join(b, list(keys), "full").select(
        *keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), (F.coalesce("n_a", F.lit(0)) * pixel_area).alias("area"),
        F.try_divide(F.coalesce("n_b", F.lit(0)), F.coalesce("n_a", F.lit(0))).alias("coverage"),
    )


def weighted_mean_shear(rows: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), velocity="velocity", weight="weight") -> DataFrame:
    """Weighted mean and shear in two passes: deviations are taken from the mean, not from squares."""
    keys = list(keys)
    r = rows.select(*keys, clean(velocity).alias("v"), clean(weight).alias("w")).where("w > 0 and v is not null")
    means = r.groupBy(*keys).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))
    d = F.col("v") - F.col("mean")
    return r.join(means, keys).groupBy(*keys).agg(F.first("mean").alias("mean"), F.sqrt(F.greatest(F.sum(F.col("w") * d * d) / F.sum("w"), F.lit(0.0))).alias("shear"))


def mad_scale(rows: DataFrame, keys: Sequence[str], value="value", fallback_std: bool = False) -> DataFrame:
    """Per key: n, median and 1.4826 * median |v - median|; optionally the population deviation where that is 0."""
    keys = list(keys)
    r = rows.select(*keys, clean(value).alias("v")).where("v is not null")
    centres = r.groupBy(*keys).agg(median("v").alias("median"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"))
    joined = r.join(centres, keys) if keys else r.crossJoin(F.broadcast(centres))  # one row if there is no key
    out = joined.groupBy(*keys).agg(F.first("n").alias("n"), F.first("median").alias("median"), F.first("std").alias("std"), (MAD_TO_SIGMA * median(F.abs(F.col("v") - F.col("median")))).alias("scale"))
    return out.withColumn("scale", F.when(F.lit(fallback_std) & (F.col("scale") == 0), F.col("std")).otherwise(F.col("scale"))).drop("std")


def variance_scale(rows: DataFrame, keys: Sequence[str], residual="residual", sigma="sigma", least: int = 10) -> DataFrame:
    """Squared robust scale of residual / sigma; NULL below `least` samples."""
    z = F.when(clean(sigma) > 0, clean(residual) / clean(sigma))
    found = mad_scale(rows.withColumn("z_value", z), keys, "z_value")
    return found.select(*keys, "n", F.when(F.col("n") >= least, F.col("scale") * F.col("scale")).alias("variance_scale"))


def array_corr(pairs) -> Column:
    """Pearson correlation of the fields a and b of an array of pairs; NULL where either does not vary."""
    p = col(pairs)
    mean = lambda f: F.aggregate(p, F.lit(0.0), lambda s, x: s + x[f]) / F.size(p)
    both = F.struct(mean("a").alias("a"), mean("b").alias("b"))
    zero = F.struct(F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"), F.lit(0.0).alias("ab"))
    add = lambda m: lambda s, x: F.struct(
        (s["aa"] + F.pow(x["a"] - m["a"], 2)).alias("aa"), (s["bb"] + F.pow(x["b"] - m["b"], 2)).alias("bb"), (s["ab"] + (x["a"] - m["a"]) * (x["b"] - m["b"])).alias("ab")
    )
    sums = lambda m: F.aggregate(p, zero, add(m), lambda s: F.try_divide(s["ab"], F.sqrt(s["aa"] * s["bb"])))
    return F.get(F.transform(F.array(both), sums), F.lit(0))  # the means are found once


def spectral_correlation(residuals: DataFrame, max_lag: int, keys: Sequence[str] = ("target_id", "arm"), row="spaxel", least: int = 10) -> DataFrame:
    """Median over rows of the lagged Pearson correlation, relative to lag 0. `residuals`: keys, row, chan, z."""
    if max_lag < 0:
        raise ValueError("max_lag must not be negative")
    keys = list(keys)
    packed = residuals.where("z is not null").groupBy(*keys, row).agg(F.array_sort(F.collect_list(F.struct("chan", "z"))).alias("zs"))
    at_lag = packed.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag))))
    # a sample's partner stands among the next lag places of its array
    later = lambda x, i: F.get(F.filter(F.slice("zs", i + 1, F.col("lag") + 1), lambda y: y["chan"] == x["chan"] + F.col("lag")), F.lit(0))["z"]
    pairs = F.filter(F.transform("zs", lambda x, i: F.struct(x["z"].alias("a"), later(x, i).alias("b"))), lambda p: p["b"].isNotNull())
    per_row = at_lag.withColumn("pairs", pairs).where(F.size("pairs") >= least).select(*keys, row, "lag", array_corr("pairs").alias("r"))
    lags = per_row.groupBy(*keys, "lag").agg(median(clean("r")).alias("r"), F.count("*").alias("n_rows"))
    zero = lags.where("lag = 0").select(*keys, F.col("r").alias("r0"))
    joined = lags.join(zero, keys) if keys else lags.crossJoin(F.broadcast(zero))
    return joined.select(*keys, "lag", F.try_divide("r", "r0").alias("correlation"), "n_rows")


def group_interval(rows: DataFrame, group: Sequence[str], value="value") -> DataFrame:
    p = exact_percentiles(rows, group, value, {"p16": 0.16, "median": 0.5, "p84": 0.84})
    return p.select(*group, "median", (F.col("median") - F.col("p16")).alias("minus"), (F.col("p84") - F.col("median")).alias("plus"), "n")


def group_rms(residuals: DataFrame, first: str, second: str, keys: Sequence[str] = (), value="residual") -> DataFrame:
    """RMS of all residuals, and of the medians per first, per second and per pair of groups (one cube)."""
    keys, v = list(keys), col(value)
    medians = residuals.cube(*keys, first, second).agg(median(v).alias("m"), F.grouping_id().alias("g"))
    medians = medians.where(F.col("g") < 4).where(F.col("g") != 3)  # keys are never rolled up
    level = F.when(F.col("g") == 0, "pair").when(F.col("g") == 1, "first").otherwise("second")
    grouped = medians.groupBy(*keys, level.alias("level")).agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("rms"), F.count("*").alias("n_groups"))
    total = residuals.groupBy(*keys).agg(F.sqrt(F.avg(v * v)).alias("rms"), F.count(v).alias("n_groups")).select(*keys, F.lit("all").alias("level"), "rms", "n_groups")
    return grouped.unionByName(total)


def dispersion_step(pixels: DataFrame, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    """Median positive |step| of wavelength along rows and along columns; the larger of the two."""
    keys = list(keys)
    along_y = F.abs(F.col("wave") - F.lag("wave").over(Window.partitionBy(*keys, "x").orderBy("y")))
    along_x = F.abs(F.col("wave") - F.lag("wave").over(Window.partitionBy(*keys, "y").orderBy("x")))
    found = pixels.withColumns({"dy": along_y, "dx": along_x}).groupBy(*keys).agg(median(F.when(F.col("dy") > 0, F.col("dy"))).alias("dy"), median(F.when(F.col("dx") > 0, F.col("dx"))).alias("dx"))
    return found.withColumn("step", F.greatest("dy", "dx"))


def value_counts(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, value).agg(F.count("*").alias("n"))


def binary_counts(rows: DataFrame, mask, keys: Sequence[str] = ()) -> DataFrame:
    m = col(mask).cast("int")
    return rows.groupBy(*keys).agg(F.count_if(m == 0).alias("n_zero"), F.count_if(m != 0).alias("n_set"), F.count("*").alias("n"))


def exposure_summary(rows: DataFrame, exposure="exposure", keys: Sequence[str] = ()) -> DataFrame:
    e = F.when(clean(exposure) > 0, clean(exposure))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(e).alias("n_positive"), F.try_divide(F.count(e), F.count("*")).alias("positive_fraction"), F.min(e).alias("min"), median(e).alias("median"), F.max(e).alias("max")
    )


def exposure_map(samples: DataFrame, keys: Sequence[str] = ("target_id", "arm", "y", "x")) -> DataFrame:
    e = F.when(F.col("good_wave"), F.coalesce(clean("exposure"), F.lit(0.0)))
    return samples.groupBy(*keys).agg(median(e).alias("exposure"), F.avg((e > 0).cast("int")).alias("coverage_fraction"))


def weighted_centroid(image: DataFrame, keys: Sequence[str] = ("target_id", "arm"), min_percentile: float = 0.9, value="value") -> DataFrame:
    """Flux-weighted mean position of the pixels at or above a percentile of the positive ones; NULL below three."""
    keys = list(keys)
    pos = image.select(*keys, "y", "x", clean(value).alias("v")).where("v > 0")
    limit = pos.groupBy(*keys).agg(F.percentile("v", F.lit(min_percentile)).alias("limit"), F.count("*").alias("n_positive"))
    bright = (pos.join(small_side(limit), keys) if keys else pos.crossJoin(F.broadcast(limit))).where((F.col("v") >= F.col("limit")) & (F.col("n_positive") >= 3))
    return bright.groupBy(*keys).agg((F.sum(F.col("v") * F.col("y")) / F.sum("v")).alias("y"), (F.sum(F.col("v") * F.col("x")) / F.sum("v")).alias("x"), F.count("*").alias("n"))


def total_chi2(rows: DataFrame, keys: Sequence[str], data="data", model="model", sigma="sigma") -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.pow((col(data) - col(model)) / col(sigma), 2)).alias("chi2"), F.count("*").alias("n"))


def normalize_scale(spectra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median |flux| of valid pixels, or its upper quartile if that is 0; NULL if neither is positive."""
    p = F.percentile(F.when(valid_sample(), F.abs("flux")), F.array(F.lit(0.5), F.lit(0.75)))
    return spectra.groupBy(*keys).agg(p.alias("p")).select(*keys, F.when(F.col("p")[0] > 0, F.col("p")[0]).when(F.col("p")[1] > 0, F.col("p")[1]).alias("scale"))


def normalize_templates(templates: DataFrame, low: float, high: float, least: int = 10) -> DataFrame:
    """Each template over its mean in the window; a non-positive mean or too few pixels is an error."""
    inside = F.col("wave").between(low, high)
    w = Window.partitionBy("template_id")  # one template's pixels
    mean, n = F.avg(F.when(inside, F.col("value"))).over(w), F.count_if(inside).over(w)
    checked = templates.withColumn("mean", mean).withColumn("n", n)
    checked = checked.where(F.assert_true((F.col("mean") > 0) & (F.col("n") >= least), "a template has no positive mean in the window").isNull())
    return checked.withColumn("value", F.col("value") / F.col("mean")).drop("mean", "n")


def achieved_fraction(weights: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), tolerance: float = 0.02) -> DataFrame:
    """Share of component 0 in the weights against the requested share."""
    a = F.sum(F.when(F.col("component") == 0, F.col("weight")).otherwise(0.0))
    total = F.sum("weight")
    found = weights.groupBy(*keys).agg(F.when(total > 0, a / total).alias("fraction"), F.max("requested").alias("requested"))
    return found.withColumn("warn", F.coalesce(F.abs(F.col("fraction") - F.col("requested")) > tolerance, F.lit(False)))


def sn_summary(bins: DataFrame, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    return bins.groupBy(*keys).agg(F.count("sn").alias("n_valid"), median("sn").alias("median_sn"), F.min("sn").alias("min_sn"), F.max("sn").alias("max_sn"))


def robust_limits(rows: DataFrame, value="value", low: float = 0.02, high: float = 0.98, keys: Sequence[str] = ()) -> DataFrame:
    """Percentile limits; minimum and maximum where these coincide; NULL where those do."""
    p = exact_percentiles(rows, keys, value, {"lo": low, "hi": high})
    pair = F.when(F.col("hi") > F.col("lo"), F.struct("lo", "hi")).when(F.col("highest") > F.col("lowest"), F.struct(F.col("lowest").alias("lo"), F.col("highest").alias("hi")))
    return p.select(*keys, pair.alias("pair")).select(*keys, F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"))


def shared_upper_limit(a: DataFrame, b: DataFrame, p: float = 0.95, keys: Sequence[str] = ("target_id",), value="sn") -> DataFrame:
    both = a.select(*keys, clean(value).alias("v")).unionAll(b.select(*keys, clean(value).alias("v")))
    limit = F.col("upper")
    return exact_percentiles(both, keys, "v", {"upper": p}).select(*keys, F.when(limit > 0, limit).alias("upper"))


def false_positive_probability(observed: DataFrame, mocks: DataFrame, stratum: Sequence[str], obs="statistic", mock="statistic", obs_id="obs_id") -> DataFrame:
    """(mocks at or above + 1) / (mocks + 1) per observation.

    Mocks are counted by value before anything is ranked; the counts ahead are running sums by
    ranges, so a stratum of any size is spread. Strata that are NULL or without mocks have no rows.
    """
    stratum = list(stratum)
    known = " and ".join(f"{s} is not null" for s in stratum) or "true"
    v = clean(mock).alias("v")
    by_value = mocks.select(*stratum, (-v).alias("down"), F.lit(1).alias("n_here")).unionByName(observed.select(*stratum, (-clean(obs)).alias("down"), F.lit(0).alias("n_here")))
    by_value = materialize(by_value.where(f"down is not null and {known}").groupBy(*stratum, "down").agg(F.sum("n_here").alias("n_here")), "mock-counts")
    ranked = prefix_sums(by_value, stratum, ["down"], "n_here").select(*stratum, "down", (F.col("before") + F.col("n_here")).alias("above"))
    totals = by_value.groupBy(*stratum).agg(F.sum("n_here").alias("n_mocks")).where("n_mocks > 0")
    rows = observed.select(*stratum, col(obs_id).alias("obs_id"), clean(obs).alias("statistic"), (-clean(obs)).alias("down")).join(ranked, [*stratum, "down"])
    rows = rows.join(totals, stratum) if stratum else rows.crossJoin(F.broadcast(totals))  # one row if there is no stratum
    return rows.select(*stratum, "obs_id", "statistic", ((F.col("above") + 1) / (F.col("n_mocks") + 1)).alias("probability"), "n_mocks")


def recovery_probability(rows: DataFrame, stratum: Sequence[str], flag="recovered") -> DataFrame:
    return rows.groupBy(*stratum).agg(F.avg(col(flag).cast("int")).alias("probability"), F.count(col(flag)).alias("n"))


def power_sums(rows: DataFrame, order: int, keys: Sequence[str], x="x", y="y") -> DataFrame:
    v, u = col(x), col(y)
    return rows.groupBy(*keys).agg(*[F.sum(F.pow(v, k)).alias(f"s{k}") for k in range(2 * order + 1)], *[F.sum(u * F.pow(v, k)).alias(f"t{k}") for k in range(order + 1)])


def solve_normal(order: int) -> list[Column]:
    """Coefficients, highest power first, from power sums of order 1 or 2 (Cramer's rule on centred x)."""
    s, t = [F.col(f"s{k}") for k in range(2 * order + 1)], [F.col(f"t{k}") for k in range(order + 1)]
    if order == 1:
        det = s[0] * s[2] - s[1] * s[1]
        return [F.try_divide(s[0] * t[1] - s[1] * t[0], det), F.try_divide(s[2] * t[0] - s[1] * t[1], det)]
    if order != 2:
        raise ValueError("beyond order 2 use solve_any")

    def det3(a, b, c):
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])

    rows = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]
    det = det3(*rows)
    out = []
    for k in (2, 1, 0):
        replaced = [[t[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]
        out.append(F.try_divide(det3(*replaced), det))
    return out


def solve_any(sums: DataFrame, order: int, keys: Sequence[str]) -> DataFrame:
    """(keys, coeffs, n) from power sums of any order: one small linear system a key, solved in batches."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a = np.stack([f[[f"s{i + j}" for j in range(order + 1)]].to_numpy(float) for i in range(order + 1)], axis=1)
            b = f[[f"t{i}" for i in range(order + 1)]].to_numpy(float)
            found = [np.linalg.lstsq(p, q, rcond=None)[0][::-1] for p, q in zip(a, b)]
            yield f[list(keys)].assign(coeffs=found, n=f["s0"])

    shape = ", ".join(f"`{k}` {dict(sums.dtypes)[k]}" for k in keys)
    return sums.mapInPandas(work, f"{shape}, coeffs array<double>, n double")


def robust_polyfit(
    rows: DataFrame, order: int, clip: float = 3.0, rounds: int = 5, keys: Sequence[str] = ("target_id",), x="x", y="y", with_rows: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Per key: coefficients in x - x_mean (highest power first), x_mean, n kept, residual scale.

    `with_rows` also returns the rows with kept and d, their distance from the fit; other columns stay.

    Each round fits, measures the residuals' robust scale over the kept rows, and clips about
    their median; keys that no longer change simply fit the same rows again.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in {*keys, "x", "y"}]
    r = rows.select(*keys, *rest, clean(x).alias("x"), clean(y).alias("y")) if with_rows else rows.select(*keys, clean(x).alias("x"), clean(y).alias("y"))
    r, rest = r.where("x is not null and y is not null"), rest if with_rows else []
    centred = r.join(r.groupBy(*keys).agg(F.avg("x").alias("x_mean")), keys).withColumn("u", F.col("x") - F.col("x_mean")).withColumn("kept", F.lit(True))
    centred = materialize(centred, "polyfit")

    def fit(df: DataFrame) -> DataFrame:
        f = power_sums(df.where("kept"), order, keys, "u", "y")
        if order > 2:
            return solve_any(f, order, keys)
        return f.select(*keys, F.array(*solve_normal(order)).alias("coeffs"), F.col("s0").alias("n"))

    value = F.aggregate("coeffs", F.lit(0.0), lambda a, c: a * F.col("u") + c)
    for _ in range(rounds):
        d = centred.join(fit(centred), keys).withColumn("d", F.col("y") - value)
        stats = mad_scale(d.where("kept"), keys, "d").withColumnsRenamed({"median": "mid", "n": "n_kept"})
        near = F.abs(F.col("d") - F.col("mid")) <= clip * F.col("scale")
        going = (F.col("scale") > 0) & (F.col("n_kept") > order + 2)
        d = d.join(stats, keys).withColumn("kept", F.when(going, near).otherwise(F.col("kept")))
        centred = materialize(d.select(*keys, *rest, "x", "y", "x_mean", "u", "kept"), "polyfit")  # else the plan triples each round
    final = fit(centred)
    scales = mad_scale(centred.join(final.drop("n"), keys).withColumn("d", F.col("y") - value).where("kept"), keys, "d").select(*keys, "scale")
    means = centred.groupBy(*keys).agg(F.first("x_mean").alias("x_mean"), F.min(F.when(F.col("kept"), F.col("x"))).alias("support_min"), F.max(F.when(F.col("kept"), F.col("x"))).alias("support_max"))
    fitted = final.join(means, keys).join(scales, keys)
    if not with_rows:
        return fitted
    return fitted, centred.join(final.drop("n"), keys).withColumn("model", value).withColumn("d", F.col("y") - F.col("model")).select(*keys, *rest, "x", "y", "model", "d", "kept")
