"""Analytic operators along the spectral axis: smoothing, residuals, peaks, line fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean, col
from skyloom.operators.aggregates import MAD_TO_SIGMA, array_median
from skyloom.operators.joins import interp_gaps
from skyloom.sources.scratch import small_side


def fir_coefficients(window: int, poly: int) -> np.ndarray:
    """Row k: weights over the window for the local polynomial's value at position k (window x window)."""
    h = window // 2
    a = np.vander(np.arange(-h, h + 1) / max(1, h), poly + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def smooth_array(values: Column, window: int, poly: int) -> Column:
    """Local polynomials over an array by fixed weights; the ends take the polynomial of the first and last window.

    One pass over the array, no row leaves its task. Arrays shorter than the window give NULL.
    """
    h = window // 2
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in fir_coefficients(window, poly)])
    n = F.size(values)
    first = lambda i: F.greatest(F.lit(0), F.least(i - h, n - window))
    dot = lambda i: F.aggregate(F.zip_with(F.slice(values, first(i) + 1, window), F.get(table, i - first(i)), lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b)
    return F.when(n >= window, F.transform(F.sequence(F.lit(0), n - 1), dot))


def fir_smooth(spectra: DataFrame, window: int = 31, poly: int = 2, keys: Sequence[str] = ("target_id", "arm", "spaxel"), value: str = "filled") -> DataFrame:
    """Adds smooth. Channels are numbered from 0 without gaps within a key (fill gaps first); a spectrum becomes one array row."""
    keys, rest = list(keys), [c for c in spectra.columns if c not in {*keys, "chan"}]
    packed = spectra.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chan", *rest))).alias("rows"))
    packed = packed.withColumn("smooth", smooth_array(F.transform("rows", lambda r: r[value].cast("double")), window, poly))
    return packed.select(*keys, F.inline(F.arrays_zip("rows", "smooth"))).select(*keys, "rows.*", "smooth")


def highpass_residuals(samples: DataFrame, window: int = 31, poly: int = 2, clip: float = 5.0, keys: Sequence[str] = ("target_id", "arm", "spaxel")) -> DataFrame:
    """(keys, chan, z): valid samples over their noise after smoothing, clipped about each row's median.

    One shuffle brings a spectrum together; gaps, smoothing, medians and clipping all work on it there.
    """
    keys = list(keys)
    ok = F.coalesce(F.col("good") & (clean("unc") > 0) & clean("flux").isNotNull(), F.lit(False))
    rows = samples.select(*keys, "chan", "flux", "unc", ok.alias("valid"), F.when(ok, F.col("flux")).alias("masked"))
    filled = interp_gaps(rows, keys, "masked")
    packed = filled.groupBy(*keys).agg(F.count_if("valid").alias("n_valid"), F.array_sort(F.collect_list(F.struct("chan", "filled", "flux", "unc", "valid"))).alias("rows"))
    packed = packed.where(F.col("n_valid") >= max(10, window))
    packed = packed.withColumn("smooth", smooth_array(F.col("rows.filled"), window, poly))
    z = F.zip_with("rows", "smooth", lambda r, s: F.struct(r["chan"].alias("chan"), F.when(r["valid"], (r["flux"] - s) / r["unc"]).alias("z")))
    packed = packed.select(*keys, F.filter(z, lambda x: x["z"].isNotNull()).alias("zs")).withColumn("mid", array_median("zs.z"))
    packed = packed.withColumn("scale", MAD_TO_SIGMA * array_median(F.transform("zs", lambda x: F.abs(x["z"] - F.col("mid")))))
    loose = (F.size("zs") < 10) | (F.col("scale") <= 0)
    kept = F.when(loose, F.col("zs")).otherwise(F.filter("zs", lambda x: F.abs(x["z"] - F.col("mid")) <= clip * F.col("scale")))
    return packed.select(*keys, F.inline(kept))


def cumulative_mass(states: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight="p") -> DataFrame:
    """Adds cum: running weight in a total order; end the order with the cell's id."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return states.withColumn("cum", F.sum(col(weight)).over(w))


def running_median_baseline(rows: DataFrame, half: int, keys: Sequence[str], order: str = "k", value: str = "v") -> DataFrame:
    """Adds base: the median of a centred odd window, edges held at the nearest value."""
    h = max(9, 2 * half + 5)
    h = (h + 1 - h % 2) // 2
    w = Window.partitionBy(*keys).orderBy(order)
    around = F.collect_list(value).over(w.rowsBetween(-h, h))
    nth, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    rows = rows.withColumns({"around": around, "before": F.greatest(F.lit(0), h + 1 - nth), "behind": F.greatest(F.lit(0), nth + h - n)})
    full = F.array_sort(F.concat("around", F.array_repeat(F.element_at("around", 1), F.col("before").cast("int")), F.array_repeat(F.element_at("around", -1), F.col("behind").cast("int"))))
    return rows.withColumn("base", F.element_at(full, h + 1)).drop("around", "before", "behind")


def find_peaks(rows: DataFrame, distance: int, keys: Sequence[str], order: str = "k", value: str = "high") -> DataFrame:
    """(keys, order, value) of local maxima that are high, prominent and apart.

    Height is the 70th percentile of the positive values; prominence at least
    max(0.05 * maximum, 0.1 * height). Keeping the higher of two near peaks is inherently
    ordered, so each (slice, position) group of bounded length is one Arrow batch.
    """
    keys = list(keys)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        v = frame[value].to_numpy(float)
        positive = v[v > 0]
        if len(v) < 3 or not len(positive):
            return frame.iloc[:0]
        height = np.quantile(positive, 0.7)
        need = max(0.05 * v.max(), 0.1 * height)
        tops = [i for i in range(1, len(v) - 1) if v[i] > v[i - 1] and v[i] >= v[i + 1] and v[i] >= height]
        kept: list[int] = []
        for i in sorted(tops, key=lambda i: -v[i]):
            left, right = v[:i], v[i + 1 :]
            higher_left, higher_right = np.flatnonzero(left > v[i]), np.flatnonzero(right > v[i])
            lo = left[higher_left[-1] + 1 :] if len(higher_left) else left
            hi = right[: higher_right[0]] if len(higher_right) else right
            base = max(lo.min() if len(lo) else v[i], hi.min() if len(hi) else v[i])
            if v[i] - base >= need and all(abs(i - j) >= distance for j in kept):
                kept.append(i)
        return frame.iloc[sorted(kept)]

    picked = rows.select(*keys, order, value)
    return picked.groupBy(*keys).applyInPandas(work, picked.schema)


def gaussian_fits(u: np.ndarray, y: np.ndarray, ok: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Damped Gauss-Newton for many small fits at once: (parameters, residuals).

    Each row of u, y and ok (which samples count) is one line; parameters are amplitude, centre,
    sigma, level and slope, kept within low and high. A parameter at its bound rests while the
    normal equations push it outwards. A step that does not lower the sum of squares is taken
    back and the damping raised; a line is done when its steps no longer matter.
    """

    def model(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (u - p[:, 1:2]) / p[:, 2:3]
        return np.exp(-0.5 * z * z), z

    def residual(p: np.ndarray, u: np.ndarray, y: np.ndarray, ok: np.ndarray) -> np.ndarray:
        e, _ = model(p, u)
        return np.where(ok, y - p[:, 0:1] * e - p[:, 3:4] - p[:, 4:5] * u, 0.0)

    p, damping, live = start.copy(), np.full(len(u), 1e-3), np.arange(len(u))
    for _ in range(rounds):
        if not len(live):
            break
        q, uu, yy, good = p[live], u[live], y[live], ok[live]
        e, z = model(q, uu)
        r = residual(q, uu, yy, good)
        a, sigma = q[:, 0:1], q[:, 2:3]
        slopes = np.stack([e, a * e * z / sigma, a * e * z * z / sigma, np.ones_like(uu), uu], axis=2) * good[:, :, None]
        down = np.einsum("nmi,nm->ni", slopes, r)
        rests = ((q <= low) & (down < 0)) | ((q >= high) & (down > 0))
        slopes, down = slopes * ~rests[:, None, :], np.where(rests, 0.0, down)
        normal = np.einsum("nmi,nmj->nij", slopes, slopes)
        size = np.einsum("nii->ni", normal)
        ridge = damping[live][:, None] * size + 1e-12 * (1 + size.max(axis=1, keepdims=True))
        step = np.linalg.solve(normal + ridge[:, :, None] * np.eye(5), down[:, :, None])[:, :, 0]
        trial = np.clip(q + step, low, high)
        was, now = (r * r).sum(axis=1), (residual(trial, uu, yy, good) ** 2).sum(axis=1)
        better = now <= was
        p[live[better]] = trial[better]
        damping[live] = np.where(better, np.maximum(damping[live] * 0.2, 1e-14), damping[live] * 10)
        small = (np.abs(trial - q) <= 1e-11 * (1 + np.abs(q))).all(axis=1)
        live = live[~(small | (damping[live] > 1e12))]
    return p, residual(p, u, y, ok)


def line_fit(peaks: DataFrame, pixels: DataFrame, half: int, keys: Sequence[str], order: str = "k", step: str = "step") -> DataFrame:
    """Gaussian lines on a sloping ground, by least squares over the samples within `half` of each peak.

    `peaks`: keys, order; `pixels`: keys, order, wave, value, step. A line needs seven samples and a peak
    above the median of the two samples at either end. Adds centre, sigma, fwhm, amplitude and
    chi_proxy, the mean squared residual over its robust scale; a width outside 0.25 to 20 steps
    drops the line. A line's samples are one row, so all its rounds run where it lies.
    """
    keys = list(keys)
    near = peaks.select(*keys, F.col(order).alias("peak"), F.explode(F.sequence(F.col(order) - half, F.col(order) + half)).alias(order))
    rows = near.join(pixels.select(*keys, order, "wave", "value", step), [*keys, order]).where(clean("wave").isNotNull())
    group = [*keys, "peak"]
    lines = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, "wave", "value"))).alias("w"), F.max(F.when(F.col(order) == F.col("peak"), F.col("wave"))).alias("w0"), F.max(step).alias("step"))
    lines = lines.where((F.size("w") >= 7) & F.col("w0").isNotNull() & (F.col("step") > 0)).where(~F.exists("w", lambda x: clean(x["value"]).isNull()))
    lines = lines.select(*group, "w0", "step", F.col("w.wave").alias("waves"), F.col("w.value").alias("values"))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            n = f["values"].map(len).to_numpy()
            ok = np.arange(n.max())[None, :] < n[:, None]
            u, y = np.zeros(ok.shape), np.zeros(ok.shape)
            u[ok], y[ok] = np.concatenate(f["waves"].to_list()), np.concatenate(f["values"].to_list())
            w0, width = f["w0"].to_numpy(float), f["step"].to_numpy(float)
            u = np.where(ok, (u - w0[:, None]) / width[:, None], 0.0)
            ends = np.stack([y[:, 0], y[:, 1], y[np.arange(len(n)), n - 2], y[np.arange(len(n)), n - 1]], axis=1)
            ground = np.median(ends, axis=1)
            top = y[np.arange(len(n)), np.abs(np.where(ok, u, np.inf)).argmin(axis=1)] - ground
            unit = np.where(top > 0, top, 1.0)
            start = np.stack([np.ones(len(n)), np.zeros(len(n)), np.ones(len(n)), np.zeros(len(n)), np.zeros(len(n))], axis=1)
            low, high = np.array([0.0, -1.5, 0.15, -np.inf, -np.inf]), np.array([np.inf, 1.5, 8.0, np.inf, np.inf])
            p, r = gaussian_fits(u, (y - ground[:, None]) / unit[:, None], ok, start, low, high)
            proxy = []
            for row, good in zip(r, ok):
                x = row[good]
                scale = 1.4826 * np.median(np.abs(x - np.median(x))) or np.std(x)
                proxy.append(float(np.mean((x / scale) ** 2)) if scale > 0 else None)
            out = f[group].assign(centre=w0 + p[:, 1] * width, sigma=p[:, 2] * width, fwhm=p[:, 2] * width * 2.3548200450309493, amplitude=p[:, 0] * unit, chi_proxy=proxy)
            found = p[:, 2] * 2.3548200450309493
            yield out[(top > 0) & np.isfinite(p).all(axis=1) & (found >= 0.25) & (found <= 20.0)]

    shape = ", ".join(f"`{k}` {dict(lines.dtypes)[k]}" for k in group)
    return lines.mapInPandas(fit, f"{shape}, centre double, sigma double, fwhm double, amplitude double, chi_proxy double")


def parabolic_peak(before, at, after) -> Column:
    """Sub-pixel offset of a maximum from its neighbours, clipped to one pixel; 0 where undefined."""
    a, b, c = clean(before), clean(at), clean(after)
    d = a - 2 * b + c
    off = F.when(F.abs(d) > 1e-30, 0.5 * (a - c) / d)
    return F.when(off.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), off)))


def position_bins(pixels: DataFrame, n: int, keys: Sequence[str] = ("target_id", "slice_id"), pos="pos") -> DataFrame:
    """Adds position_bin: quantile bins of the position within each slice, the last one closed; repeated edges make one bin."""
    keys = list(keys)
    edges = pixels.groupBy(*keys).agg(F.array_distinct(F.percentile(col(pos), F.array(*[F.lit(k / n) for k in range(n + 1)]))).alias("edges"))
    rows = pixels.join(small_side(edges), keys)
    below = F.size(F.filter("edges", lambda e: e <= col(pos)))
    return rows.withColumn("position_bin", F.least(F.greatest(below - 1, F.lit(0)), F.greatest(F.size("edges") - 2, F.lit(0)))).drop("edges")


def consecutive_diff(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    return rows.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def coverage_extremes(spectra: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """The bins with the earliest first, the latest last and the widest span of good pixels; the first bin on ties."""
    spans = spectra.where("good").groupBy(*keys, "bin_id").agg(F.min("chan").alias("lo"), F.max("chan").alias("hi"))
    picks = spans.groupBy(*keys).agg(
        F.min(F.struct("lo", "bin_id")).alias("first"), F.min(F.struct((-F.col("hi")).alias("hi"), "bin_id")).alias("last"), F.min(F.struct((F.col("lo") - F.col("hi")).alias("w"), "bin_id")).alias("widest")
    )
    return picks.select(*keys, F.explode(F.array_sort(F.array_distinct(F.array("first.bin_id", "last.bin_id", "widest.bin_id")))).alias("bin_id"))


