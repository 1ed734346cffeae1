"""Joins of the domain: membership, projected pixels, intervals, lags, shifts, headers.

Interval joins become equi-joins: the grid cell or window numbers that a row touches are
computed and exploded, the exact overlap is applied afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean, clean_token, frame_of, medium_of, pixel_scale, pixel_to_world, sky_separation, world_to_pixel
from skyloom.operators.filters import valid_sample
from skyloom.operators.tiles import correlation_sums
from skyloom.sources.scratch import small_side

WCS_COLUMNS = ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")


def members(samples: DataFrame, membership: DataFrame, keys: Sequence[str] = ("target_id", "arm", "y", "x")) -> DataFrame:
    return samples.join(membership, list(keys))


def with_wcs(pixels: DataFrame, wcs_a: DataFrame, wcs_b: DataFrame) -> DataFrame:
    """Pixels of image b with their 0-based position (px, py) in image a; one WCS row per target on each side."""
    a = small_side(wcs_a.select("target_id", *[F.col(c).alias(f"a_{c}") for c in WCS_COLUMNS]))
    b = small_side(wcs_b.select("target_id", *[F.col(c).alias(f"b_{c}") for c in WCS_COLUMNS]))
    rows = pixels.join(b, "target_id")
    ra, dec = pixel_to_world("x", "y", {c: F.col(f"b_{c}") for c in WCS_COLUMNS})
    # the sky position is a column before the second projection: each of its terms is then found once, not wherever it is used
    sky = rows.withColumns({"sky_ra": ra, "sky_dec": dec}).drop(*[f"b_{c}" for c in WCS_COLUMNS])
    px, py = world_to_pixel("sky_ra", "sky_dec", {c: F.col(f"a_{c}") for c in WCS_COLUMNS})
    return sky.join(a, "target_id").withColumns({"px": px, "py": py}).drop("sky_ra", "sky_dec", *[f"a_{c}" for c in WCS_COLUMNS])


def nearest_members(projected: DataFrame, membership: DataFrame, scale: float, max_distance: float, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Pixels with (px, py) in the bin of the nearest pixel, if within `max_distance` (arcsec): adds bin_id, match_distance."""
    yi, xi = (F.coalesce(F.rint(c).cast("int"), F.lit(-1 << 31)) for c in ("py", "px"))  # never NULL: else the projection is repeated in tests for it
    d = F.hypot(F.col("px") - F.rint("px"), F.col("py") - F.rint("py")) * scale
    rows = projected.withColumns({"yi": yi, "xi": xi, "match_distance": d})
    m = membership.select(*keys, F.col("y").alias("yi"), F.col("x").alias("xi"), "bin_id")
    return rows.join(m, [*keys, "yi", "xi"])


def transfer_membership(pixels: DataFrame, membership: DataFrame, wcs_a: DataFrame, wcs_b: DataFrame, *, scale: float, max_distance: float) -> DataFrame:
    """Bins of image a carried to the good pixels of image b: (target_id, y, x, bin_id, match_distance)."""
    near = nearest_members(with_wcs(pixels.where("good"), wcs_a, wcs_b), membership, scale, max_distance)
    return near.where(F.col("match_distance") <= max_distance).select("target_id", "y", "x", "bin_id", "match_distance")


def transfer_fraction(near: DataFrame, max_distance: float, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Share of the pixels that fall on a binned pixel and are close enough; the denominator ignores the distance."""
    return near.groupBy(*keys).agg(F.avg((F.col("match_distance") <= max_distance).cast("int")).alias("fraction"), F.count("*").alias("n_inside"))


def check_sampling(wcs_a: DataFrame, wcs_b: DataFrame, tolerance: float) -> DataFrame:
    """Per target the largest fractional difference of the pixel scales and areas, and whether it is within tolerance."""
    size = lambda d: d.select("target_id", pixel_scale("cd11", "cd21").alias("sx"), pixel_scale("cd12", "cd22").alias("sy"))
    a, b = size(wcs_a), size(wcs_b).withColumnsRenamed({"sx": "tx", "sy": "ty"})
    off = lambda p, q: F.abs(q / p - 1)
    worst = F.greatest(off(F.col("sx"), F.col("tx")), off(F.col("sy"), F.col("ty")), off(F.col("sx") * F.col("sy"), F.col("tx") * F.col("ty")))
    return a.join(b, "target_id").select("target_id", worst.alias("difference"), (worst <= tolerance).alias("same"))


def bin_values_on_map(membership: DataFrame, bins: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    return membership.join(bins, list(keys), "left")


def reproject_bilinear(projected: DataFrame, image: DataFrame, keys: Sequence[str] = ("target_id",), value="value") -> DataFrame:
    """Target pixels with source positions (px, py) and the bilinear value there.

    Inside is 0 <= px <= nx - 1 and the same in y; missing source values count as 0 there; outside is NULL.
    """
    keys = list(keys)
    size = image.groupBy(*keys).agg(F.max("y").alias("ymax"), F.max("x").alias("xmax"))
    rows = projected.join(small_side(size), keys) if keys else projected.crossJoin(F.broadcast(size))
    inside = F.col("px").between(F.lit(0), F.col("xmax")) & F.col("py").between(F.lit(0), F.col("ymax"))
    rows = rows.withColumn("overlap", inside)
    y0, x0 = F.floor("py").cast("int"), F.floor("px").cast("int")
    fy, fx = F.col("py") - F.floor("py"), F.col("px") - F.floor("px")
    corner = lambda dy, dx, w: F.struct((y0 + dy).alias("sy"), (x0 + dx).alias("sx"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))
    spread = rows.where("overlap").select(*keys, "y", "x", F.inline(corners)).where("w > 0")
    source = image.select(*keys, F.col("y").alias("sy"), F.col("x").alias("sx"), F.coalesce(clean(value), F.lit(0.0)).alias("v"))
    sums = spread.join(source, [*keys, "sy", "sx"], "left").groupBy(*keys, "y", "x").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("value"))
    return rows.select(*keys, "y", "x", "overlap").join(sums, [*keys, "y", "x"], "left")


def pixel_edges(spectra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds e0 and e1, midway to the neighbours; the outer half steps mirror the inner ones."""
    w = Window.partitionBy(*keys).orderBy("wave")
    up, down = F.lead("wave").over(w), F.lag("wave").over(w)
    return spectra.withColumns({"e0": F.col("wave") - F.coalesce(F.col("wave") - down, up - F.col("wave")) / 2, "e1": F.col("wave") + F.coalesce(up - F.col("wave"), F.col("wave") - down) / 2})


def overlapping_pixels(e0: Column, e1: Column, low: float, step: float, n: int) -> Column:
    """Numbers of the output pixels of a grid regular in ln(wavelength) that [e0, e1) touches."""
    first = F.greatest(F.lit(0), (F.floor(F.log(e0 / low) / step - 1e-9)).cast("int"))
    last = F.least(F.lit(n - 1), (F.floor(F.log(e1 / low) / step + 1e-9)).cast("int"))
    return F.when((e1 > low) & (first <= last), F.sequence(first, last))


def overlap_rebin(spectra: DataFrame, low: float, step: float, n: int, *, min_valid: float = 0.5, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """Overlap-weighted flux, unc and coverage on n pixels of width `step` in ln(wavelength) from `low`; every pixel has a row."""
    keys = list(keys)
    rows = pixel_edges(spectra, keys).where(valid_sample("flux", "unc", "good"))
    spread = rows.select(*keys, "flux", "unc", "e0", "e1", F.explode(overlapping_pixels(F.col("e0"), F.col("e1"), low, step, n)).alias("pix"))
    left, right = low * F.exp(F.col("pix") * step), low * F.exp((F.col("pix") + 1) * step)
    spread = spread.withColumn("o", F.least(right, F.col("e1")) - F.greatest(left, F.col("e0"))).where("o > 0")
    o = F.col("o")
    sums = spread.groupBy(*keys, "pix").agg(F.sum(o).alias("so"), F.sum(o * F.col("flux")).alias("sf"), F.sum(F.pow(o * F.col("unc"), 2)).alias("sv"))
    every = spectra.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pix"))
    found = every.join(sums, [*keys, "pix"], "left")
    coverage = F.coalesce(F.col("so"), F.lit(0.0)) / (right - left)
    flux, unc = F.try_divide("sf", "so"), F.sqrt(F.try_divide(F.col("sv"), F.col("so") * F.col("so")))
    good = F.coalesce((coverage >= min_valid) & (unc > 0), F.lit(False))
    return found.select(*keys, "pix", F.sqrt(left * right).alias("wave"), flux.alias("flux"), unc.alias("unc"), coverage.alias("coverage"), good.alias("good"))


def overlap_rebin_templates(templates: DataFrame, low: float, step: float, n: int) -> DataFrame:
    """Overlap-weighted mean of each template over all its pixels; pixels without overlap have no row."""
    rows = pixel_edges(templates, ["template_id"])
    spread = rows.select("template_id", "value", "e0", "e1", F.explode(overlapping_pixels(F.col("e0"), F.col("e1"), low, step, n)).alias("pix"))
    o = F.least(low * F.exp((F.col("pix") + 1) * step), F.col("e1")) - F.greatest(low * F.exp(F.col("pix") * step), F.col("e0"))
    spread = spread.withColumn("o", o).where("o > 0")
    return spread.groupBy("template_id", "pix").agg((F.sum(F.col("o") * F.col("value")) / F.sum("o")).alias("value"))


def variable_gaussian_smooth(templates: DataFrame, sigma: Column, reach: float = 4.0) -> DataFrame:
    """Normalised Gaussian of a width that varies with wavelength, cut at `reach` widths; width 0 keeps the value.

    The band join is an equi-join on wavelength buckets of the table's widest reach.
    """
    rows = templates.select("template_id", "pix", "wave", "value", F.coalesce(clean(sigma), F.lit(0.0)).alias("s"))
    widest = rows.agg(F.max("s")).first()[0] or 0.0
    width = max(1e-6, reach * widest)
    bucket = F.floor(F.col("wave") / width).cast("long")
    out = rows.withColumn("bucket", bucket)
    near = rows.select("template_id", F.col("wave").alias("w2"), F.col("value").alias("v2"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    d = F.col("w2") - F.col("wave")
    pairs = out.join(near, ["template_id", "bucket"]).where((F.abs(d) <= reach * F.col("s")) | (d == 0))
    k = F.when(F.col("s") > 0, F.exp(-0.5 * F.pow(d / F.nullif(F.col("s"), F.lit(0.0)), 2))).otherwise(F.lit(1.0))
    return pairs.groupBy("template_id", "pix", "wave").agg((F.sum(k * F.col("v2")) / F.sum(k)).alias("value"))


def interp_curve(points: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Adds v at radius r: linear between a key's nodes, from (0, 0), NULL beyond the last. A key's nodes are a short array."""
    from skyloom.functions.scalar import interpolate_nodes

    packed = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("nodes"))
    return points.join(packed, list(keys), "left").withColumn("v", interpolate_nodes("r", "nodes")).drop("nodes")


def interp_gaps(spectra: DataFrame, keys: Sequence[str], value="flux", order: str = "chan") -> DataFrame:
    """Adds filled: missing samples linear between the nearest valid ones, the edges at the nearest value."""
    w = Window.partitionBy(*keys).orderBy(order)
    pair = F.when(clean(value).isNotNull(), F.struct(F.col(order).alias("c"), clean(value).alias("v")))
    before = F.last(pair, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(pair, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = spectra.withColumns({"before": before, "after": after})
    a, b = F.col("before"), F.col("after")
    mid = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col(order) - a["c"], b["c"] - a["c"])
    return rows.withColumn("filled", F.coalesce(clean(value), mid, a["v"], b["v"])).drop("before", "after")


def scan_windows(
    spectra: DataFrame, low: float, high: float, width: float, step: float, *, min_channels: int = 5, extreme: float = 1e3, keys: Sequence[str] = (), bin_key: str = "bin_id"
) -> DataFrame:
    """Signal to noise of all bins in closed sliding windows: a sample joins its windows by number, not by range."""
    keys = list(keys)
    n = int((high - low - width) / step + 1e-9) + 1
    first = F.greatest(F.lit(0), F.ceil((F.col("wave") - (low + width)) / step - 1e-9).cast("int"))
    last = F.least(F.lit(n - 1), F.floor((F.col("wave") - low) / step + 1e-9).cast("int"))
    rows = spectra.where(F.col("wave").between(low, high)).withColumn("windows", F.when(first <= last, F.sequence(first, last)))
    rows = rows.select(*keys, bin_key, "chan", "flux", "unc", "good", F.explode("windows").alias("window_id"))
    native = rows.groupBy(*keys, "window_id").agg(F.countDistinct("chan").alias("n_native"))
    ok = rows.where(valid_sample("flux", "unc", "good"))
    med = lambda c: F.percentile(c, F.lit(0.5))
    bins = ok.groupBy(*keys, "window_id", bin_key).agg(F.count("*").alias("n"), med("flux").alias("f"), med("unc").alias("u")).withColumn("sn", F.col("f") / F.col("u"))
    enough = F.col("n") >= min_channels
    positive = F.when(enough & (F.col("f") > 0), F.col("sn"))
    found = bins.groupBy(*keys, "window_id").agg(
        F.count_if(enough).alias("n_evaluable"), F.count(positive).alias("n_positive"), F.percentile(positive, F.array(F.lit(0.1), F.lit(0.5))).alias("p"), F.count_if(enough & (F.abs("sn") > extreme)).alias("n_extreme")
    )
    return found.join(native, [*keys, "window_id"]).select(
        *keys, "window_id", (low + width / 2 + step * F.col("window_id")).alias("center"), "n_native", "n_evaluable", "n_positive", F.try_divide("n_positive", "n_evaluable").alias("positive_fraction"),
        F.col("p")[1].alias("median_sn"), F.col("p")[0].alias("p10_sn"), F.try_divide("n_extreme", "n_evaluable").alias("extreme_fraction"),
    )


def shift_pairs(a: DataFrame, b: DataFrame, max_dy: int, max_dx: int, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """sum a[k] * b[k - L] and the number of pairs for every integer shift L in the window. Images: keys, y, x, v."""
    return correlation_sums(a, b, max_dy, max_dx, keys)


def lag_pairs(residuals: DataFrame, max_lag: int, keys: Sequence[str], row: str = "spaxel") -> DataFrame:
    """Pairs (chan, lag, z0, z1) of samples a lag apart, both valid."""
    a = residuals.select(*keys, row, "chan", F.col("z").alias("z0")).where("z0 is not null")
    b = a.select(*keys, row, F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), (F.col("chan") - F.col("lag")).alias("chan"), F.col("z0").alias("z1"))
    return a.join(b, [*keys, row, "chan"])


def state_grid(bins: DataFrame, grid: DataFrame) -> DataFrame:
    """Every state for every bin; the grid is a parameter and small."""
    return bins.crossJoin(F.broadcast(grid))


def pivot_headers(headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return headers.groupBy("file_id").pivot("key", list(keys)).agg(F.first("value", ignorenulls=True))


def match_headers(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """(file_id, key, reason) of every difference: a key on one side only, numbers not close, texts that differ once cleaned."""
    pick = lambda d, v: (d if keys is None else d.where(F.col("key").isin(list(keys)))).select("file_id", "key", F.col("value").alias(v))
    both = pick(a, "va").join(pick(b, "vb"), ["file_id", "key"], "full")
    na, nb = F.col("va").try_cast("double"), F.col("vb").try_cast("double")
    close = (F.isnan(na) & F.isnan(nb)) | (F.abs(na - nb) <= atol + rtol * F.abs(nb))
    numbers = na.isNotNull() & nb.isNotNull()
    reason = (
        F.when(F.col("va").isNull() & F.col("vb").isNull(), None).when(F.col("va").isNull(), "missing in a").when(F.col("vb").isNull(), "missing in b")
        .when(numbers & ~close, "number").when(~numbers & (clean_token("va") != clean_token("vb")), "text")
    )
    return both.select("file_id", "key", reason.alias("reason")).where("reason is not null")


def match_calibration(pairs: DataFrame, expected_grating: Column | str, tolerance: float) -> DataFrame:
    """Adds violation: the first rule that a science file and its arc break, else NULL; blanks are tolerated.

    `pairs` has s_ and a_ columns CAMERA, GRATING, IFUNAM, BINNING, CWAVE.
    """
    t = lambda c: F.nullif(clean_token(c), F.lit(""))
    differ = lambda k: F.coalesce(t(f"s_{k}") != t(f"a_{k}"), F.lit(False))
    wanted = F.nullif(clean_token(expected_grating), F.lit(""))
    off = F.abs(F.col("s_CWAVE").try_cast("double") - F.col("a_CWAVE").try_cast("double")) > tolerance
    code = (
        F.when(differ("CAMERA"), "camera").when(F.coalesce(t("s_GRATING") != wanted, F.lit(False)), "science grating").when(F.coalesce(t("a_GRATING") != wanted, F.lit(False)), "arc grating")
        .when(differ("GRATING"), "grating").when(differ("IFUNAM"), "ifu").when(differ("BINNING"), "binning").when(F.coalesce(off, F.lit(False)), "central wavelength")
    )
    return pairs.withColumn("violation", code)


def check_conventions(wide: DataFrame, configured_medium: str = "auto", configured_frame: str = "auto", template_medium: str = "vacuum") -> DataFrame:
    """Per file: medium and frame, from the header unless configured, an error text, and whether templates need converting."""
    header = {c: F.col(c).cast("string") for c in wide.columns if c != "file_id"}
    found = {"medium": (medium_of(header), configured_medium), "frame": (frame_of(header), configured_frame)}
    out, errors = {}, []
    for name, (seen, given) in found.items():
        if given in ("auto", "unknown"):
            out[name] = seen
            errors.append(F.when(seen.isNull(), f"{name} undecided"))
        else:
            out[name] = F.lit(given)
            errors.append(F.when(seen.isNotNull() & (seen != given), f"{name} contradicts the header"))
    rows = wide.select("file_id", out["medium"].alias("medium"), out["frame"].alias("frame"), F.coalesce(*errors).alias("error"))
    return rows.withColumn("conversion_required", F.coalesce(F.col("medium") != template_medium, F.lit(False)))


def pairwise_separation(centers: DataFrame, warn: float, key: str = "target_id") -> DataFrame:
    """Largest separation of a target's few centre estimates (ids i < j) and whether it exceeds `warn` arcsec."""
    a, b = centers.select(key, "id", "ra", "dec"), centers.select(key, F.col("id").alias("id2"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    far = a.join(b, key).where("id < id2").groupBy(key).agg(F.max(sky_separation("ra", "dec", "ra2", "dec2")).alias("separation"))
    return centers.select(key).distinct().join(far, key, "left").select(key, F.coalesce("separation", F.lit(0.0)).alias("separation"), F.coalesce(F.col("separation") > warn, F.lit(False)).alias("warn"))


def common_wave_interval(a: DataFrame, b: DataFrame, min_width: float, min_channels: int, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """The overlap of both arms' good channels, and whether it is wide and full enough to be used."""
    span = lambda d, s: d.where("good").groupBy(*keys).agg(F.min("wave").alias(f"lo_{s}"), F.max("wave").alias(f"hi_{s}"))
    lo, hi = F.greatest("lo_a", "lo_b"), F.least("hi_a", "hi_b")
    spans = span(a, "a").join(span(b, "b"), list(keys)).select(*keys, lo.alias("lo"), hi.alias("hi"))
    spans = small_side(spans)
    count = lambda d, s: d.where("good").join(spans, list(keys)).where(F.col("wave").between(F.col("lo"), F.col("hi"))).groupBy(*keys).agg(F.count("*").alias(f"n_{s}"))
    rows = spans.join(count(a, "a"), list(keys), "left").join(count(b, "b"), list(keys), "left").fillna(0, ["n_a", "n_b"])
    reason = F.when(F.col("hi") - F.col("lo") < min_width, "overlap too narrow").when(F.least("n_a", "n_b") < min_channels, "too few channels").otherwise("common interval")
    return rows.withColumn("reason", reason).withColumn("used", reason == "common interval")


