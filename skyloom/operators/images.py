"""Image operators: smoothing, significance, registration, components, apertures, adaptive bins.

Wide neighbourhoods are tiles with halos (`tiles`), narrow ones joins with a fixed table of
offsets; images themselves are never broadcast and never collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean
from skyloom.operators import tiles
from skyloom.operators.aggregates import MAD_TO_SIGMA, bin_capacity, weighted_centroid
from skyloom.operators.joins import shift_pairs
from skyloom.operators.ranking import exact_percentiles
from skyloom.operators.sorts import brightest
from skyloom.operators.windows import parabolic_peak
from skyloom.sources.scratch import materialize, small_side

KEYS = ("target_id", "arm")


def gaussian_1d(sigma: float, radius: int) -> list[float]:
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [v / sum(k) for v in k]


def smooth_image(image: DataFrame, sigma: float, keys: Sequence[str] = KEYS, value="value") -> DataFrame:
    """NULL-aware Gaussian, separable, edges held at the nearest pixel. The image has a row for every pixel."""
    keys = list(keys)
    v = clean(value)
    if sigma <= 0:
        return image.select(*keys, "y", "x", v.alias("smooth"))
    return tiles.smoothed(image, gaussian_1d(sigma, int(4 * sigma + 0.5)), keys, v)


def smoothed_significance(image: DataFrame, sigma: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """sum k S / sqrt(sum k^2 N^2) over valid neighbours, for valid pixels. `image`: signal, noise, valid."""
    keys = list(keys)
    valid = image.where(F.col("valid") & (clean("noise") > 0) & clean("signal").isNotNull()).select(*keys, "y", "x", F.col("signal").cast("double").alias("signal"), F.col("noise").cast("double").alias("noise"))
    if sigma <= 0:
        return valid.select(*keys, "y", "x", (F.col("signal") / F.col("noise")).alias("significance"))
    return tiles.significance(valid, gaussian_1d(sigma, max(1, math.ceil(4 * sigma))), keys)


def image_scale(rows: DataFrame, keys: Sequence[str], value="value") -> DataFrame:
    """Per image: n, median and 1.4826 * median |v - median|, the population deviation where that is 0.

    The medians come from brackets and counts (`ranking`), so an image's pixels stay spread.
    """
    keys = list(keys)
    r = materialize(rows.select(*keys, clean(value).alias("v")).where("v is not null"), "scale")
    with_stats = lambda d, stats: d.join(stats, keys) if keys else d.crossJoin(F.broadcast(stats))  # noqa: E731  # one row per image
    centres = materialize(exact_percentiles(r, keys, "v", {"median": 0.5}).select(*keys, "median"), "median")
    away = with_stats(r, centres).select(*keys, F.abs(F.col("v") - F.col("median")).alias("away"))
    found = with_stats(centres, exact_percentiles(away, keys, "away", {"mad": 0.5}).select(*keys, "mad"))
    found = with_stats(found, r.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("v").alias("std")))
    scale = MAD_TO_SIGMA * F.col("mad")
    return found.select(*keys, "n", "median", F.when(scale == 0, F.col("std")).otherwise(scale).alias("scale"))


def robust_normalize(image: DataFrame, keys: Sequence[str] = KEYS, value="value", least: int = 9) -> DataFrame:
    """Adds v = (value - median) / robust scale inside the mask, 0 outside; too few pixels or no scale is an error."""
    keys = list(keys)
    stats = image_scale(image.where("mask"), keys, value)
    rows = image.join(stats, keys) if keys else image.crossJoin(F.broadcast(stats))  # one row per image
    rows = rows.where(F.assert_true((F.col("n") >= least) & (F.col("scale") > 0), "too few pixels or no spread").isNull())
    return rows.withColumn("v", F.when(F.col("mask"), (clean(value) - F.col("median")) / F.col("scale")).otherwise(0.0)).drop("n", "median", "scale")


def contrast_snr(image: DataFrame, sigma: float, keys: Sequence[str] = KEYS, value="value", least: int = 25, used: str | None = None) -> DataFrame:
    """(P99 - median) / robust scale of the smoothed image, at least 0; NULL below `least` pixels.

    The whole image is smoothed; `used` names the pixels that count, else all do.
    """
    keys = list(keys)
    smooth = smooth_image(image, sigma, keys, value).where("smooth is not null")
    if used:
        smooth = smooth.join(image.where(used).select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
    smooth = materialize(smooth, "contrast")
    stats = image_scale(smooth, keys, "smooth")
    tops = exact_percentiles(smooth, keys, "smooth", {"p99": 0.99}).select(*keys, "p99")
    rows = stats.join(tops, keys) if keys else stats.crossJoin(F.broadcast(tops))
    snr = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("p99") - F.col("median"), F.col("scale")), F.lit(0.0)))
    return rows.select(*keys, F.when(F.col("n") >= least, snr).alias("contrast"), "n")


def registration_shift(a: DataFrame, b: DataFrame, max_shift: int, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """The shift of b against a that correlates best, refined by parabolas. Images: keys, y, x, v (normalised).

    A shift counts with more than nine pairs and a tenth of those at no shift, which may be none.
    """
    keys = list(keys)
    pairs = shift_pairs(a, b, max_shift, max_shift, keys)
    at_zero = pairs.groupBy(*keys).agg(F.max(F.when((F.col("ly") == 0) & (F.col("lx") == 0), F.col("n")).otherwise(0)).alias("n0"))
    joined = pairs.join(at_zero, keys) if keys else pairs.crossJoin(F.broadcast(at_zero))  # one row if there is no key
    corr = joined.where(F.col("n") > F.greatest(F.lit(9.0), 0.1 * F.col("n0"))).withColumn("c", F.col("s") / F.col("n"))
    w = Window.partitionBy(*keys, "lx").orderBy("ly")
    u = Window.partitionBy(*keys, "ly").orderBy("lx")
    corr = corr.withColumns({"fy": parabolic_peak(F.lag("c").over(w), "c", F.lead("c").over(w)), "fx": parabolic_peak(F.lag("c").over(u), "c", F.lead("c").over(u))})
    best = F.max(F.struct("c", (-F.col("ly")).alias("ny"), (-F.col("lx")).alias("nx"), "fy", "fx", "n")).alias("b")
    return corr.groupBy(*keys).agg(best).select(*keys, (-F.col("b.ny")).alias("ly"), (-F.col("b.nx")).alias("lx"), (F.col("b.fy") - F.col("b.ny")).alias("dy"), (F.col("b.fx") - F.col("b.nx")).alias("dx"), F.col("b.c").alias("correlation"), F.col("b.n").alias("n"))


def shared_pixels(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, x, va, vb, used): all pixels of both images; used where both have a mask and a finite value."""
    side = lambda d, n: d.select(*keys, "y", "x", F.when(F.col("mask"), clean("value")).alias(f"v{n}"))
    both = side(a, "a").join(side(b, "b"), [*keys, "y", "x"], "full")
    return both.withColumn("used", F.col("va").isNotNull() & F.col("vb").isNotNull())


def difference_image(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """(keys, y, x, difference) of both images, each over its own robust scale, where both have pixels. Images: value, mask."""
    keys = list(keys)
    used = shared_pixels(a, b, keys).where("used").withColumn("mask", F.lit(True))
    left = robust_normalize(used, keys, "va").withColumnRenamed("v", "na")
    both = robust_normalize(left, keys, "vb")
    return both.select(*keys, "y", "x", (F.col("na") - F.col("v")).alias("difference"))


def register_pair(a: DataFrame, b: DataFrame, max_shift: int, *, contrast: float = 5.0, sigma: float = 1.0, margin: float = 0.75, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Shift with a verdict, over the pixels that both images have. Images: value, mask.

    Both images need contrast there; a shift near the limit is inconclusive. overlap_fraction is
    the share of a's pixels that are used, rms_difference that of the difference image.
    Every image of a has a row, whatever is left of it.
    """
    keys = list(keys)
    both = materialize(shared_pixels(a, b, keys), "registration")
    used = both.where("used").withColumn("mask", F.lit(True))
    sizes = both.groupBy(*keys).agg(F.count_if("used").alias("n_used"), F.count("va").alias("n_a")).where("n_a > 0")
    rows = sizes.select(*keys, "n_used", (F.col("n_used") / F.col("n_a")).alias("overlap_fraction"))
    enough = used.join(sizes.where("n_used >= 9").select(*keys), keys, "left_semi") if keys else used
    for name in ("a", "b"):
        found = contrast_snr(both, sigma, keys, f"v{name}", used="used").select(*keys, F.col("contrast").alias(f"contrast_{name}"))
        rows = rows.join(found, keys, "left") if keys else rows.join(found, how="left")
    na, nb = (robust_normalize(enough, keys, f"v{name}").select(*keys, "y", "x", "v") for name in ("a", "b"))
    shift = registration_shift(na, nb, max_shift, keys)
    pixel = [*keys, "y", "x"]
    apart = na.withColumnRenamed("v", "na").join(nb, pixel).groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("na") - F.col("v"), 2))).alias("rms_difference"))
    for found in (shift, apart):
        rows = rows.join(found, keys, "left") if keys else rows.join(found, how="left")
    low = F.coalesce(F.least("contrast_a", "contrast_b"), F.lit(0.0)) < contrast
    edge = F.greatest(F.abs("dy"), F.abs("dx")) >= max_shift - margin
    reason = F.when(F.col("n_used") == 0, "no overlap").when(low, "low contrast").when(F.col("dy").isNull(), "no shift").when(edge, "shift at the limit").otherwise("ok")
    valid = reason == "ok"
    shown = [F.when(valid, F.col(c)).alias(c) for c in ("dy", "dx")]
    return rows.select(*keys, "contrast_a", "contrast_b", *shown, "correlation", "overlap_fraction", "rms_difference", valid.alias("valid"), reason.alias("reason"))


def center_estimate(image: DataFrame, sigma: float, keys: Sequence[str] = KEYS) -> DataFrame:
    return brightest(smooth_image(image, sigma, keys), keys, "smooth")


def center_agreement(image: DataFrame, sigma: float, limit: float, keys: Sequence[str] = KEYS, min_percentile: float = 0.9) -> DataFrame:
    """The image's centre as the peak of the smoothed image, with the flux-weighted centroid beside it.

    separation is the distance of the two, warn where it is beyond the limit or there is no centroid.
    """
    keys = list(keys)
    smooth = materialize(smooth_image(image, sigma, keys), "centre")
    peak = brightest(smooth, keys, "smooth").withColumnRenamed("value", "top")
    centroid = weighted_centroid(smooth, keys, min_percentile, "smooth").select(*keys, F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("n").alias("n_bright"))
    rows = peak.join(centroid, keys, "left") if keys else peak.join(centroid, how="left")
    separation = F.hypot(F.col("cy") - F.col("y"), F.col("cx") - F.col("x"))
    return rows.select(*keys, "y", "x", "top", "cy", "cx", "n_bright", separation.alias("separation"), F.coalesce(separation > limit, F.lit(True)).alias("warn"))


def connected_components(pixels: DataFrame, keys: Sequence[str] = KEYS, width: int = 1 << 20, max_rounds: int = 64) -> DataFrame:
    """4-connected components of the given pixels: adds label, the least row-major pixel number of the component.

    Labels flow to neighbours, then jump to their label's label, so rounds grow with the
    logarithm of a component's extent; all images advance together.
    """
    keys = list(keys)
    number = F.col("y").cast("long") * width + F.col("x")
    steps = F.broadcast(pixels.sparkSession.createDataFrame([(0, 1), (0, -1), (1, 0), (-1, 0)], "dy int, dx int"))
    ids = pixels.select(*keys, "y", "x", number.alias("id")).distinct()
    moved = ids.crossJoin(steps).select(*keys, F.col("id").alias("a"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    edges = materialize(moved.join(ids, [*keys, "y", "x"]).select(*keys, "a", F.col("id").alias("b")), "components")
    now = materialize(ids.withColumn("label", F.col("id")), "components")
    for _ in range(max_rounds):
        near = edges.join(now.select(*keys, F.col("id").alias("b"), F.col("label").alias("lb")), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("lb").alias("lb"))
        hooked = now.join(near, [*keys, "id"], "left").withColumn("least", F.least("label", F.coalesce("lb", "label")))
        # the label's own pixel takes the least label that any of its pixels sees
        root = hooked.groupBy(*keys, "label").agg(F.min("least").alias("root"))
        stepped = hooked.join(root, [*keys, "label"]).select(*keys, "y", "x", "id", F.col("label").alias("old"), F.col("root").alias("label"))
        jump = stepped.select(*keys, F.col("id").alias("label"), F.col("label").alias("jump"))
        now = materialize(stepped.join(jump, [*keys, "label"], "left").select(*keys, "y", "x", "id", F.least("label", F.coalesce("jump", "label")).alias("label"), "old"), "components")
        changed = not now.where("label <> old").isEmpty()
        now = now.drop("old")
        if not changed:
            return now.select(*keys, "y", "x", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def dilate(pixels: DataFrame, n: int, bounds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All pixels within n steps of the given ones that are on the grid; `bounds`: keys, y, x of the whole image."""
    near = [(dy, dx) for dy in range(-n, n + 1) for dx in range(abs(dy) - n, n - abs(dy) + 1)]
    steps = F.broadcast(pixels.sparkSession.createDataFrame(near, "dy int, dx int"))
    moved = pixels.select(*keys, "y", "x").crossJoin(steps).select(*keys, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
    return moved.join(bounds.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def analysis_aperture(
    image: DataFrame, centers: DataFrame, *, threshold: float = 2.0, sigma: float = 1.5, grow: int = 1, max_distance: float = 5.0, least: int = 1, all_good: bool = False, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The pixels of each image's aperture: the detected component nearest the centre, dilated, valid pixels only.

    `image`: signal, noise, good; `centers`: keys, cy, cx in pixels.
    """
    keys = list(keys)
    valid = image.where(F.col("good") & clean("signal").isNotNull() & (clean("noise") > 0))
    if all_good:
        return valid.select(*keys, "y", "x")
    found = smoothed_significance(valid.withColumn("valid", F.lit(True)), sigma, keys).where(F.col("significance") >= threshold)
    labels = connected_components(found, keys)
    at = labels.join(small_side(centers), keys) if keys else labels.crossJoin(F.broadcast(centers))  # one centre per image
    dist = at.groupBy(*keys, "label").agg(F.min(F.hypot(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))).alias("d"))
    best = dist.groupBy(*keys).agg(F.min(F.struct("d", "label")).alias("b")).where(F.col("b.d") <= max_distance).select(*keys, F.col("b.label").alias("label"))
    core = labels.join(small_side(best), [*keys, "label"], "left_semi")
    aperture = dilate(core, grow, valid, keys)
    sizes = aperture.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*keys)
    return aperture.join(small_side(sizes), keys, "left_semi") if keys else aperture


def first_cell(mean_r: float) -> float:
    """A few widths of a bin, whose generators have half its radius."""
    return max(2.0, 6.0 * mean_r)


def met_in_cells(pixels: DataFrame, generators: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Each pixel with the generators of its cell and the eight around it.

    Pixels are dealt to all tasks: a narrow table is few files, but its pairs are some tens of rows each.
    """
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = generators.select(*keys, "bin_id", "gx", "gy", "r", at("gy").alias("by"), F.explode(F.transform(around, lambda k: k + at("gx"))).alias("cx"))
    spread = spread.select(*keys, "bin_id", "gx", "gy", "r", "cx", F.explode(F.transform(around, lambda k: k + F.col("by"))).alias("cy"))
    return pixels.withColumns({"cy": at("y"), "cx": at("x")}).repartition(parts, *keys, "cy", "cx").join(spread, [*keys, "cy", "cx"])


def power_assign(pixels: DataFrame, generators: DataFrame, keys: Sequence[str] = ("target_id",), cell: float | None = None) -> DataFrame:
    """Each pixel's generator of least d^2 - r^2, ties to the lowest id. `generators`: bin_id, gx, gy, r.

    Generators are met in a pixel's cell and the eight around it. One beyond is a cell's width away
    at least, so a pixel is settled once its best value is below what such a one could have; for
    the others cells are twice as wide in the next round. Unless given, the first width is a few
    times that of a bin, so a pixel meets some tens of generators, however large the image.
    """
    keys = list(keys)
    p = pixels.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    g = generators.agg(F.min("gx"), F.max("gx"), F.min("gy"), F.max("gy"), F.max("r"), F.avg("r")).first()
    if p[0] is None or g[0] is None:
        return pixels.withColumn("bin_id", F.lit(None).cast(generators.schema["bin_id"].dataType))
    span = max(max(p[k + 1], g[k + 1]) - min(p[k], g[k]) for k in (0, 2))
    widest, cell = g[4], cell or first_cell(g[5])
    d = F.pow(F.col("x") - F.col("gx"), 2) + F.pow(F.col("y") - F.col("gy"), 2) - F.col("r") * F.col("r")
    left, found = pixels.select(*keys, "y", "x"), None
    while True:
        near = met_in_cells(left, generators, keys, cell).groupBy(*keys, "y", "x").agg(F.min(F.struct(d.alias("d"), "bin_id")).alias("b"))
        whole = cell >= span
        settled = near if whole else near.where(F.col("b.d") <= cell**2 - widest**2)
        settled = materialize(settled.select(*keys, "y", "x", F.col("b.bin_id").alias("bin_id")), "assigned")
        found = settled if found is None else found.unionByName(settled)
        if whole:
            break
        left = materialize(left.join(settled, [*keys, "y", "x"], "left_anti"), "unassigned")
        if left.isEmpty():
            break
        cell *= 2
    return pixels.join(found, [*keys, "y", "x"], "left")


def in_ranges(rows: DataFrame, keys: Sequence[str], order: str, amount: Column, bits: int) -> DataFrame:
    """Adds `running`, the sum of `amount` up to and with each row in the order of the integer `order`.

    Ranges of 2^bits values are summed by themselves and start from the totals of those before,
    so no task holds more than a range.
    """
    keys = list(keys)
    rows = rows.withColumns({"part": F.shiftright(order, bits), "amount": amount})
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = rows.groupBy(*keys, "part").agg(F.sum("amount").alias("total"))
    totals = totals.select(*keys, "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys, "part").orderBy(order, *[c for c in ("y", "x") if c in rows.columns]).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(totals, [*keys, "part"])
    return found.withColumn("running", F.col("start") + F.sum("amount").over(inside)).drop("part", "amount", "start")


def adaptive_bins(pixels: DataFrame, target_sn: float, rounds: int = 3, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Bins of about equal capacity: (keys, y, x, signal, noise, bin_id), ids 0 .. N - 1 per image.

    Seeds cut the running squared signal to noise along a Morton curve into parts of the target;
    each refinement assigns pixels to the nearest generator and recomputes the generators.
    The curve has as many bits as the largest coordinate and is summed range by range.
    """
    keys = list(keys)
    p = materialize(pixels.select(*keys, "y", "x", "signal", "noise"), "pixels")
    top = p.agg(F.max(F.greatest("x", "y"))).first()[0]
    code = F.lit(0).cast("long")
    for b in range(max(1, int(top or 0).bit_length())):
        code = code + F.shiftleft(F.shiftright("x", b).bitwiseAND(1).cast("long"), 2 * b) + F.shiftleft(F.shiftright("y", b).bitwiseAND(1).cast("long"), 2 * b + 1)
    power = F.pow(F.greatest(F.col("signal") / F.col("noise"), F.lit(0.0)), 2)
    seeds = in_ranges(p.withColumn("code", code), keys, "code", power, 16)
    seeds = seeds.withColumn("bin_id", F.floor(F.col("running") / (target_sn * target_sn) - 1e-9).cast("long")).drop("code", "running")
    now = materialize(seeds, "bins")
    radius = lambda n: F.sqrt(n / F.pi())
    for _ in range(rounds):
        generators = materialize(now.groupBy(*keys, "bin_id").agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"), (radius(F.count("*")) * 0.5).alias("r")), "generators")
        moved = power_assign(p, generators, keys)
        kept = now.select(*keys, "y", "x", F.col("bin_id").alias("old"))
        now = materialize(moved.join(kept, [*keys, "y", "x"]).withColumn("bin_id", F.coalesce("bin_id", "old")).drop("old"), "bins")
    ids = now.select(*keys, "bin_id").distinct()
    ids = in_ranges(ids, keys, "bin_id", F.lit(1), 12).withColumn("new_id", (F.col("running") - 1).cast("int"))
    return now.join(ids.drop("running"), [*keys, "bin_id"]).select(*keys, "y", "x", "signal", "noise", F.col("new_id").alias("bin_id"))


def bin_table(members: DataFrame, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """npix, capacity, single, centroid and equivalent radius, from the final membership."""
    keys = list(keys)
    shape = members.groupBy(*keys).agg(F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"))
    return bin_capacity(members, keys).join(shape, keys).withColumn("single", F.col("npix") == 1).withColumn("radius", F.sqrt(F.col("npix") / F.pi()))


