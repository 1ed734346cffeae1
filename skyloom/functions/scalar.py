"""Scalar functions as Column expressions; everything stays inside generated code."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIGHT_KM_S = 299_792.458
SIGMA_PER_FWHM = 1.0 / math.sqrt(8.0 * math.log(2.0))


def col(c: Column | str | float | int | None) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def clean(c: Column | str) -> Column:
    """NaN and infinities as NULL: Spark's aggregates would carry them on."""
    v = col(c).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


# ---- wavelength axes and media


def wave_axis(crval, crpix, step, n) -> Column:
    """Array of crval + (i + 1 - crpix) * step for i in 0 .. n - 1."""
    return F.transform(F.sequence(F.lit(0), (col(n) - 1).cast("int")), lambda i: col(crval) + (i + 1 - col(crpix)) * col(step))


def to_angstrom(value, unit) -> Column:
    """Lengths in m, cm, mm, um, nm or Angstrom, as Angstrom; unknown units give NULL."""
    u = F.lower(F.trim(col(unit)))
    scale = F.when(u.isin("angstrom", "a", "ang", ""), 1.0).when(u == "nm", 10.0).when(u.isin("um", "micron"), 1e4).when(u == "mm", 1e7).when(u == "cm", 1e8).when(u == "m", 1e10)
    return col(value) * scale


def refractive_index(vacuum) -> Column:
    """Of standard air at a vacuum wavelength in Angstrom; below 2000 it is an error."""
    w = col(vacuum)
    s2 = F.pow(1e4 / w, 2)
    n = 1.0 + 8.34254e-5 + 2.406147e-2 / (130.0 - s2) + 1.5998e-4 / (38.9 - s2)
    return F.when(w < 2000, F.raise_error(F.lit("wavelength below 2000 Angstrom")).cast("double")).otherwise(n)


def vac_to_air(vacuum) -> Column:
    return col(vacuum) / refractive_index(vacuum)


def air_to_vac(air, rounds: int = 12) -> Column:
    """Fixed point of vacuum = air * n(vacuum), from 1.00028 * air."""
    a = col(air)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), a * 1.00028, lambda v, _: a * refractive_index(v))


def convert_medium(wave, src: str, dst: str) -> Column:
    if src == dst:
        return col(wave)
    if (src, dst) == ("vacuum", "air"):
        return vac_to_air(wave)
    if (src, dst) == ("air", "vacuum"):
        return air_to_vac(wave)
    raise ValueError(f"unknown media {src!r}, {dst!r}")


# ---- widths


def fwhm_to_sigma(fwhm) -> Column:
    return col(fwhm) * SIGMA_PER_FWHM


def sigma_to_fwhm(sigma) -> Column:
    return col(sigma) / SIGMA_PER_FWHM


def quadrature_diff(data, template) -> Column:
    """sqrt(d^2 - t^2), NULL if negative."""
    d2 = col(data) * col(data) - col(template) * col(template)
    return F.when(d2 >= 0, F.sqrt(d2))


def quadrature_violation(data, template, tolerance: float = 1e-6) -> Column:
    """Whether the difference is negative beyond rounding."""
    d2, t2 = col(data) * col(data), col(template) * col(template)
    return d2 - t2 < -tolerance * F.greatest(d2, t2)


def poly_eval(coeffs, x) -> Column:
    """Horner, highest power first."""
    v = col(x).cast("double")
    return F.aggregate(col(coeffs), F.lit(0.0), lambda s, c: s * v + c)


def support_filter(wave, value, low, high, allow_extrapolation: bool = False) -> Column:
    return col(value) if allow_extrapolation else F.when(col(wave).between(col(low), col(high)), col(value))


def unconstrained_edges(good_min, good_max, support_min, support_max) -> tuple[Column, Column]:
    """How far the good range reaches beyond the empirical support, on either side."""
    return F.greatest(F.lit(0.0), col(support_min) - col(good_min)), F.greatest(F.lit(0.0), col(good_max) - col(support_max))


def width_in_template_frame(wave, z, width: Callable[[Column], Column], template_medium: str, science_medium: str) -> Column:
    """Instrumental FWHM, known as a function of observed science wavelength, at a template's rest wavelength."""
    observed = convert_medium(wave, template_medium, science_medium) * (1.0 + col(z))
    half = width(observed) / 2.0
    edge = lambda w: convert_medium(w / (1.0 + col(z)), science_medium, template_medium)
    return edge(observed + half) - edge(observed - half)


# ---- sky geometry


def pixel_scale(cd1, cd2) -> Column:
    """Norm of one column of the CD matrix, in arcsec."""
    return F.sqrt(col(cd1) * col(cd1) + col(cd2) * col(cd2)) * 3600.0


def pixel_area(cd11, cd21, cd12, cd22) -> Column:
    return pixel_scale(cd11, cd21) * pixel_scale(cd12, cd22)


def pixel_to_world(x, y, wcs: dict[str, Column]) -> tuple[Column, Column]:
    """Gnomonic projection of 0-based pixels: (ra, dec) in degrees. `wcs`: crval1/2, crpix1/2, cd11 .. cd22."""
    u, v = col(x) + 1 - wcs["crpix1"], col(y) + 1 - wcs["crpix2"]
    xi, eta = F.radians(wcs["cd11"] * u + wcs["cd12"] * v), F.radians(wcs["cd21"] * u + wcs["cd22"] * v)
    ra0, dec0 = F.radians(wcs["crval1"]), F.radians(wcs["crval2"])
    down = F.cos(dec0) - eta * F.sin(dec0)
    ra = ra0 + F.atan2(xi, down)
    dec = F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.sqrt(xi * xi + down * down))
    return F.pmod(F.degrees(ra), F.lit(360.0)), F.degrees(dec)


def world_to_pixel(ra, dec, wcs: dict[str, Column]) -> tuple[Column, Column]:
    """0-based pixels (x, y) of a sky position in degrees."""
    a, d = F.radians(col(ra)) - F.radians(wcs["crval1"]), F.radians(col(dec))
    d0 = F.radians(wcs["crval2"])
    down = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a)
    xi, eta = F.degrees(F.cos(d) * F.sin(a) / down), F.degrees((F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a)) / down)
    det = wcs["cd11"] * wcs["cd22"] - wcs["cd12"] * wcs["cd21"]
    u, v = (wcs["cd22"] * xi - wcs["cd12"] * eta) / det, (wcs["cd11"] * eta - wcs["cd21"] * xi) / det
    return u + wcs["crpix1"] - 1, v + wcs["crpix2"] - 1


def tangent_offsets(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    """Longitude and latitude in arcsec in the frame that has the centre at its origin."""
    a, d, d0 = F.radians(col(ra) - col(ra0)), F.radians(col(dec)), F.radians(col(dec0))
    x = F.cos(d) * F.cos(a) * F.cos(d0) + F.sin(d) * F.sin(d0)
    y = F.cos(d) * F.sin(a)
    z = F.sin(d) * F.cos(d0) - F.cos(d) * F.cos(a) * F.sin(d0)
    return F.degrees(F.atan2(y, x)) * 3600.0, F.degrees(F.atan2(z, F.sqrt(x * x + y * y))) * 3600.0


def sky_separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance in arcsec, stable at any distance."""
    a, d1, d2 = F.radians(col(ra2) - col(ra1)), F.radians(col(dec1)), F.radians(col(dec2))
    up = F.sqrt(F.pow(F.cos(d2) * F.sin(a), 2) + F.pow(F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(a), 2))
    return F.degrees(F.atan2(up, F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(a))) * 3600.0


# ---- disks


def inclination(q, q0) -> Column:
    """Degrees: cos^2 i = (q^2 - q0^2) / (1 - q0^2), clipped to [0, 1]."""
    q, q0 = col(q), col(q0)
    c2 = (q * q - q0 * q0) / (1.0 - q0 * q0)
    bad = (q <= 0) | (q > 1) | (q0 < 0) | (q0 >= 1)
    i = F.degrees(F.acos(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c2)))))
    return F.when(bad, F.raise_error(F.lit("axis ratio out of range")).cast("double")).otherwise(i)


def rotate_major_minor(x, y, pa) -> tuple[Column, Column]:
    """Coordinates along the major and minor axes; position angle in degrees from +x."""
    t = F.radians(col(pa))
    return col(x) * F.cos(t) + col(y) * F.sin(t), -col(x) * F.sin(t) + col(y) * F.cos(t)


def signed_pa_coordinate(x, y, pa) -> Column:
    return rotate_major_minor(x, y, pa)[0]


def deproject(x, y, pa, i) -> tuple[Column, Column]:
    """Radius and azimuth in the disk plane."""
    major, minor = rotate_major_minor(x, y, pa)
    c = F.cos(F.radians(col(i)))
    minor = minor / F.when(c <= 1e-12, F.raise_error(F.lit("disk seen edge-on")).cast("double")).otherwise(c)
    return F.hypot(major, minor), F.atan2(minor, major)


def ring_grid(fwhm, r_target, factor: float = 1.0, space: float = 1.0) -> Column:
    """Struct(radii, delta): from factor * fwhm in steps of `space` to about r_target."""
    start = factor * col(fwhm)
    n = F.rint((col(r_target) - start) / space).cast("int")
    radii = F.when(col(r_target) < start, F.raise_error(F.lit("target radius inside the first ring")).cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n)), lambda k: start + k * F.lit(space))
    )
    return F.struct(radii.alias("radii"), F.lit(0.5 * space).alias("delta"))


def interpolate_nodes(x, nodes) -> Column:
    """Linear over ARRAY<STRUCT<r, v>> sorted by r, from (0, 0); NULL outside."""
    x = col(x)
    all_nodes = F.concat(F.array(F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("v"))), col(nodes))
    below, above = F.filter(all_nodes, lambda k: k["r"] <= x), F.filter(all_nodes, lambda k: k["r"] >= x)
    a, b = F.element_at(below, -1), F.element_at(above, 1)
    inside = (F.size(below) > 0) & (F.size(above) > 0)
    return F.when(inside, F.when(a["r"] == b["r"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * F.try_divide(x - a["r"], b["r"] - a["r"])))


def projected_velocity(x, y, pa, i, vsys, nodes) -> Column:
    r, theta = deproject(x, y, pa, i)
    return col(vsys) + interpolate_nodes(r, nodes) * F.sin(F.radians(col(i))) * F.cos(theta)


# ---- noise, brightness, likelihood


def noise_factor(n, mode: str = "none", alpha: float = 0.0) -> Column:
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    if mode == "none":
        return F.lit(1.0)
    if mode == "log10":
        return 1.0 + alpha * F.log10(F.greatest(col(n), F.lit(1)).cast("double"))
    raise ValueError(f"unknown mode {mode!r}")


def surface_brightness_scale(bunit, area) -> Column:
    u = F.regexp_replace(F.lower(col(bunit)), r"\s", "")
    per_area = u.contains("/arcsec2") | u.contains("/arcsec^2") | u.contains("arcsec-2") | u.contains("arcsec**-2")
    return F.when(per_area, col(area)).otherwise(1.0)


def relative_likelihood(dchi2) -> Column:
    return F.coalesce(F.exp(-0.5 * clean(dchi2)), F.lit(0.0))


def grid_edge_distance(index: Sequence[Column | str], shape: Sequence[int]) -> Column:
    sides = [side for c, n in zip(index, shape) for side in (col(c), F.lit(n - 1) - col(c))]
    return F.least(*sides)


def edge_warning(index, shape, cells: int = 2) -> Column:
    return grid_edge_distance(index, shape) <= cells


def component_statistic(chi2_one, chi2_two) -> Column:
    return col(chi2_one) - col(chi2_two)


# ---- grids made on the driver from parameters


def uniform_grid(low: float, high: float, n: int) -> list[float]:
    if n < 2:
        raise ValueError("a grid has two nodes at least")
    return [low + (high - low) * k / (n - 1) for k in range(n)]


def fraction_grid(low: float, high: float, step: float) -> list[float]:
    n = math.floor((high - low) / step + 0.5)
    return [v for v in (round(low + k * step, 12) for k in range(n + 1)) if v <= high + 1e-8 * step]


def log_grid_edges(low: float, high: float, velscale: float) -> list[float]:
    """Edges of pixels of equal width in ln(wavelength)."""
    step = velscale / LIGHT_KM_S
    n = math.floor(math.log(high / low) / step + 1e-9)
    if n < 10:
        raise ValueError("fewer than ten pixels")
    return [low * math.exp(k * step) for k in range(n + 1)]


def grid_table(spark: SparkSession, **axes: Sequence[float]) -> DataFrame:
    """All combinations of the axes, with each axis' index as i_<name>; as large as the parameters make it."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"i_{name} int, {name} double")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


# ---- tokens and headers


def clean_token(v) -> Column:
    return F.upper(F.trim(col(v)))


#: Spellings of media and velocity frames.
MEDIA = {"vac": "vacuum", "vacuum": "vacuum", "air": "air", "auto": "auto", "unknown": "unknown"}
FRAMES = {"bary": "barycentric", "barycentric": "barycentric", "helio": "heliocentric", "heliocentric": "heliocentric", "topo": "topocentric", "topocentric": "topocentric", "none": "none", "auto": "auto", "unknown": "unknown"}


def normalized(v, names: dict[str, str]) -> Column:
    """Trimmed, lower-cased and looked up; names outside the vocabulary are an error."""
    t = F.lower(F.trim(col(v)))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(t.isNull(), None).otherwise(F.coalesce(table[t], F.raise_error(F.concat(F.lit("unknown name: "), t)).cast("string")))


def normalize_medium(v) -> Column:
    return normalized(v, MEDIA)


def normalize_frame(v) -> Column:
    return normalized(v, FRAMES)


def medium_of(header: dict[str, Column]) -> Column:
    """From pivoted header columns: the axis type, its comment, then the medium keywords; else NULL."""
    get = lambda k: header.get(k, F.lit(None).cast("string"))
    comment = F.lower(get("CTYPE_COMMENT"))
    found = [F.when(F.upper(get("CTYPE")).contains("AWAV"), "air"), F.when(comment.contains("vacuum"), "vacuum"), F.when(comment.contains("air wavelength"), "air")]
    for key in ("WAVEMED", "WAVEMEDM", "AIRORVAC", "VACUUM"):
        t = F.lower(F.trim(get(key)))
        if key == "VACUUM":
            found.append(F.when(t.isin("t", "true", "1"), "vacuum").when(t.isin("f", "false", "0"), "air"))
        found.append(F.when(t.contains("vac"), "vacuum").when(t.contains("air"), "air"))
    return F.coalesce(*found)


def frame_of(header: dict[str, Column]) -> Column:
    found = []
    for key in ("VCORRTYP", "SPECSYS", "SSYSOBS"):
        t = F.lower(header.get(key, F.lit(None).cast("string")))
        found.append(F.when(t.contains("bary"), "barycentric").when(t.contains("helio"), "heliocentric").when(t.contains("topo"), "topocentric").when(t.contains("none"), "none"))
    return F.coalesce(*found)


def safe_fir_window(n, requested: int, poly: int) -> Column:
    """Odd, below n and at least poly + 3; NULL where there is none."""
    w = F.least(F.lit(requested), (col(n) - 1).cast("int"))
    w = F.greatest(w - (1 - w % 2), F.lit(poly + 3 + (1 - (poly + 3) % 2)))
    return F.when(w < col(n), w)


def psf_choice(configured, *header_values) -> Column:
    """Struct(fwhm, source): the configured width if positive, else the first positive header value."""
    pick = lambda v: F.when(clean(v) > 0, clean(v))
    first, rest = pick(configured), F.coalesce(*[pick(v) for v in header_values]) if header_values else F.lit(None).cast("double")
    source = F.when(first.isNotNull(), "configuration").when(rest.isNotNull(), "header").otherwise("unavailable")
    return F.struct(F.coalesce(first, rest).alias("fwhm"), source.alias("source"))


def velocity_support(max_speed, sigma_max: float, velscale, k_sigma: float = 4.0) -> Column:
    return col(max_speed) + k_sigma * sigma_max + 4.0 * col(velscale)


def velocity_scale(spectra: DataFrame, keys: Sequence[str] = ("target_id",), configured: float | None = None) -> DataFrame:
    """Per key c times the median positive step of ln(wave), NULL below five such steps; or the configured value for all."""
    if configured is not None:
        if configured <= 0:
            raise ValueError("a configured velocity scale must be positive")
        return spectra.select(*keys).distinct().withColumn("velscale", F.lit(float(configured)))
    step = F.log(clean("wave")) - F.lag(F.log(clean("wave"))).over(Window.partitionBy(*keys).orderBy("chan"))
    steps = spectra.select(*keys, step.alias("step")).where("step > 0")
    found = steps.groupBy(*keys).agg(F.percentile("step", F.lit(0.5)).alias("step"), F.count("*").alias("n"))
    return found.select(*keys, F.when(F.col("n") >= 5, LIGHT_KM_S * F.col("step")).alias("velscale"))


#: What the type of a spectral axis contains.
SPECTRAL_TYPES = ("WAVE", "AWAV", "FREQ", "VELO", "VRAD")


def spectral_axis(headers: DataFrame, strict: bool = False, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Per file the first axis whose CTYPE is spectral, and its place counted from the last axis.

    Without one the third of three axes, if the header gives its step. `strict` takes wavelengths only and has no such fallback.
    """
    axis = F.regexp_extract("key", r"^CTYPE([0-9]+)$", 1).try_cast("int")
    kinds = "WAVE|AWAV" if strict else "|".join(SPECTRAL_TYPES)
    named = F.min(F.when(F.upper("value").rlike(kinds), axis))
    last = F.max(F.when(F.col("key") == "NAXIS", F.col("value").try_cast("int")))
    stepped = F.max(F.col("key").isin("CD3_3", "CDELT3"))
    found = headers.groupBy(*keys).agg(named.alias("named"), F.coalesce(last, F.max(axis)).alias("n_axes"), stepped.alias("stepped"))
    fallback = F.lit(None).cast("int") if strict else F.when((F.col("n_axes") == 3) & F.col("stepped"), 3)
    rows = found.select(*keys, "n_axes", F.coalesce("named", fallback).alias("axis"))
    return rows.select(*keys, "axis", (F.col("n_axes") - F.col("axis")).alias("place"))
