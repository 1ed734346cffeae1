"""Line widths from arc frames, noise of sky-like spectra, and templates prepared for a fit: chains of other operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import LIGHT_KM_S, clean, fwhm_to_sigma, quadrature_diff, quadrature_violation
from skyloom.operators import aggregates as A
from skyloom.operators import grids as G
from skyloom.operators import joins as J
from skyloom.operators import sorts as S
from skyloom.operators import windows as W
from skyloom.sources.scratch import materialize


def valid_arc_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels with an arc value, a wavelength, a position and a slice from 0 on."""
    known = clean("arc").isNotNull() & clean("wave").isNotNull() & clean("pos").isNotNull() & F.coalesce(F.col("slice_id") >= 0, F.lit(False))
    return pixels.where(known)


def median_bin(pixels: DataFrame, keys: Sequence[str], *, least_pixels: int = 20, least_bins: int = 10) -> DataFrame:
    """(keys, k, wave, value, step): median arc in wavelength bins of width `step`, gaps interpolated, ends trimmed.

    `pixels`: keys, wave, arc, step, low, high. Bin k is centred on low + k * step. Groups with
    too few pixels or filled bins have no rows.
    """
    keys = list(keys)
    inside = pixels.where(F.col("wave").between(F.col("low"), F.col("high")))
    k = F.floor((F.col("wave") - F.col("low")) / F.col("step") + 0.5).cast("int")
    bins = inside.withColumn("k", k).groupBy(*keys, "k").agg(A.median("arc").alias("value"), F.count("*").alias("n"), F.first("low").alias("low"), F.first("step").alias("step"))
    group = Window.partitionBy(*keys)
    bins = bins.withColumns({"n_pixels": F.sum("n").over(group), "n_bins": F.count("*").over(group)})
    bins = bins.where((F.col("n_pixels") >= least_pixels) & (F.col("n_bins") >= least_bins))
    # a gap is filled between the filled bins on either side
    after = group.orderBy("k")
    rows = bins.withColumns({"k2": F.lead("k").over(after), "v2": F.lead("value").over(after)})
    steps = F.sequence(F.col("k"), F.coalesce(F.col("k2") - 1, F.col("k")))
    rows = rows.select(*keys, F.col("k").alias("k1"), "k2", F.col("value").alias("v1"), "v2", "low", "step", F.explode(steps).alias("k"))
    value = F.coalesce(F.col("v1") + (F.col("v2") - F.col("v1")) * F.try_divide(F.col("k") - F.col("k1"), F.col("k2") - F.col("k1")), F.col("v1"))
    return rows.select(*keys, "k", (F.col("low") + F.col("k") * F.col("step")).alias("wave"), value.alias("value"), "step")


def arc_spectra(pixels: DataFrame, n_positions: int = 3, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    """Arc spectra of each slice and position bin on the detector's own wavelength step.

    `pixels`: keys, y, x, arc, wave, slice_id, pos, and optionally low and high, the good range.
    """
    keys = list(keys)
    valid = valid_arc_pixels(pixels)
    if "low" not in pixels.columns:
        valid = valid.drop("high").join(valid.groupBy(*keys).agg(F.min("wave").alias("low"), F.max("wave").alias("high")), keys)
    steps = A.dispersion_step(valid, keys).select(*keys, "step")
    binned = W.position_bins(valid, n_positions, [*keys, "slice_id"]).join(steps, keys)
    return median_bin(binned, [*keys, "slice_id", "position_bin"])


def arc_widths(
    pixels: DataFrame, *, n_positions: int = 3, half: int = 5, distance: int = 4, order: int = 2, min_lines: int = 6, clip: float = 3.0, keys: Sequence[str] = ("target_id", "arm")
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line widths over wavelength: (model, lines, scatter), each keyed by target and arm.

    model: the clipped polynomial of FWHM (coefficients in wave - x_mean) with the support of
    the lines it keeps; lines: every fitted line with its kept flag; scatter: RMS of the
    fractional residuals of kept lines, whole and by slice and position. Fewer than
    `min_lines` lines of a key are an error.
    """
    keys = list(keys)
    group = [*keys, "slice_id", "position_bin"]
    spectra = materialize(arc_spectra(pixels, n_positions, keys), "arc-spectra")
    high = W.running_median_baseline(spectra, half, group, "k", "value").withColumn("high", F.col("value") - F.col("base"))
    peaks = W.find_peaks(high, distance, group)
    lines = materialize(W.line_fit(peaks, spectra, half, group), "arc-lines")
    found = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"))
    enough = F.assert_true(F.col("n_lines") >= min_lines, f"fewer than {min_lines} arc lines").isNull()
    lines = lines.join(found.where(enough), keys)
    fit, rows = A.robust_polyfit(lines, order, clip, keys=keys, x="centre", y="fwhm", with_rows=True)
    rows = rows.withColumn("residual", F.when(F.col("kept"), F.col("d") / F.col("model")))
    return fit, rows, A.group_rms(rows.where("kept"), "slice_id", "position_bin", keys)


def noise_characterization(
    samples: DataFrame, image: DataFrame, *, percent: float = 30.0, at_most: int = 200, window: int = 31, poly: int = 2, clip: float = 5.0, max_lag: int = 15, keys: Sequence[str] = ("target_id", "arm")
) -> tuple[DataFrame, DataFrame]:
    """(summary, correlation) of the high-pass residuals of an image's faintest good spaxels.

    summary: variance_scale (NULL below ten samples), n_spaxels, n_samples; correlation: per lag, relative to lag 0.
    """
    keys = list(keys)
    chosen = S.low_flux_selection(image, percent, at_most, keys).select(*keys, "y", "x")
    rows = samples.join(chosen, [*keys, "y", "x"], "left_semi").withColumn("spaxel", F.struct("y", "x"))
    z = materialize(W.highpass_residuals(rows, window, poly, clip, (*keys, "spaxel")), "noise-residuals")
    counts = z.groupBy(*keys).agg(F.countDistinct("spaxel").alias("n_spaxels"), F.count("*").alias("n_samples"))
    scale = A.variance_scale(z.withColumn("one", F.lit(1.0)), keys, "z", "one").select(*keys, "variance_scale")
    return counts.join(scale, keys), A.spectral_correlation(z, max_lag, keys)


def prepare_templates(
    templates: DataFrame, low: float, high: float, velscale: float, padding: float, target_fwhm: Callable[[Column], Column], *, least: int = 30, margin: float = 5.0
) -> DataFrame:
    """(template_id, pix, wave, value): cropped, smoothed to the data's width, rebinned in ln(wave), normalised on the fit range.

    `templates`: template_id, pix, wave, value, fwhm. `target_fwhm` gives the data's FWHM at a rest
    wavelength, NULL beyond its support. No support, or templates coarser than the data, is an error.
    """
    pad = math.exp(padding / LIGHT_KM_S)
    lo, hi = low / pad, high * pad
    rows = templates.where(F.col("wave").between(lo - margin, hi + margin)).withColumn("target", clean(target_fwhm(F.col("wave"))))
    supported = F.assert_true(F.col("target").isNotNull(), "a template wavelength lies beyond the support of the line widths").isNull()
    real = F.assert_true(~quadrature_violation("target", "fwhm"), "templates are coarser than the data").isNull()
    n = F.count("*").over(Window.partitionBy("template_id"))  # one template's pixels
    full = F.assert_true(F.col("n_pixels") >= least, "templates cover too little of the range").isNull()
    rows = rows.where(supported).where(real).withColumn("n_pixels", n).where(full)
    width = fwhm_to_sigma(F.coalesce(quadrature_diff("target", "fwhm"), F.lit(0.0)))
    smooth = materialize(J.variable_gaussian_smooth(rows.withColumn("add", width), F.col("add")), "templates-smooth")
    step = velscale / LIGHT_KM_S
    n_out = int(math.log(hi / lo) / step + 1e-9)
    rebinned = J.overlap_rebin_templates(smooth, lo, step, n_out)
    wave = lo * F.exp((F.col("pix") + 0.5) * step)
    return A.normalize_templates(rebinned.withColumn("wave", wave), low, high, 1).select("template_id", "pix", "wave", "value")


def preflight(one_component: DataFrame, corners: DataFrame, expected: int = 4, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """Per bin whether its single fit and all its corner states succeeded; the grid job runs only if all did.

    `one_component`: keys, ok; `corners`: keys, chi2 (NULL where the state failed).
    """
    keys = list(keys)
    done = corners.groupBy(*keys).agg(F.count(clean("chi2")).alias("n_corners"))
    rows = one_component.join(done, keys, "left").fillna(0, ["n_corners"])
    return rows.select(*keys, F.col("ok").alias("one_component"), "n_corners", (F.coalesce("ok", F.lit(False)) & (F.col("n_corners") >= expected)).alias("ready"))


def coverage_preflight(
    spectra: DataFrame, nodes: DataFrame, axes: DataFrame, bounds: tuple[float, float], fraction: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdict, single, corners): the fits of the bins that cover the extremes of each target, before any grid is run.

    `spectra`: keys (the last of them bin_id), pix, flux, unc, good pixels only. Of each target the
    bins that begin first, end last and span most are fitted with one component and at the four
    velocity corners.
    """
    keys = list(keys)
    picked = W.coverage_extremes(spectra.select(*keys, F.col("pix").alias("chan"), F.lit(True).alias("good")), keys[:-1])
    some = materialize(spectra.join(picked, keys, "left_semi"), "preflight-spectra")
    single, _ = G.single_fit(some, nodes, axes, bounds, keys)
    corners = materialize(G.corner_states(some, nodes, axes, fraction, keys), "preflight-corners")
    n = axes.agg(F.count_distinct("velocity").alias("n")).first()["n"]
    verdict = preflight(single.select(*keys, F.col("success").alias("ok")), corners, 4 if n > 1 else 1, keys)
    return materialize(verdict, "preflight"), single, corners


def gated_grid(
    spectra: DataFrame, nodes: DataFrame, axes: DataFrame, bounds: tuple[float, float], fractions: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")
) -> DataFrame:
    """`two_component_grid` behind its preflight at the middle fraction: a bin that fails there is an error, and no grid is run."""
    n = fractions.count()
    middle = fractions.where(F.col("i_f") == n // 2)
    verdict, _, _ = coverage_preflight(spectra, nodes, axes, bounds, middle, keys)
    failed = verdict.where(~F.col("ready")).orderBy(*keys).limit(5).collect()
    if failed:
        raise RuntimeError("preflight failed for " + "; ".join(", ".join(f"{k} {r[k]}" for k in keys) + f" (single fit {r['one_component']}, {r['n_corners']} corners)" for r in failed))
    return G.two_component_grid(spectra, nodes, fractions, keys)


def optional_correlation(bins: DataFrame, correlation: DataFrame | None, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    """Adds lags, the correlation by lag as an array; NULL where there is no such product."""
    keys = list(keys)
    if correlation is None:
        return bins.withColumn("lags", F.lit(None).cast("array<double>"))
    packed = correlation.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "correlation"))).alias("rows"))
    return bins.join(packed.select(*keys, F.col("rows.correlation").alias("lags")), keys, "left")
