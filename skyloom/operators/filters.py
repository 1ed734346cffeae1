"""Masks and predicates on sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean, col
from skyloom.sources.scratch import small_side


def rest_window(wave, low: float, high: float, z: float = 0.0) -> Column:
    """Whether an observed wavelength lies in the closed rest range."""
    if not (low < high and z >= 0):
        raise ValueError("the range must be increasing and z not negative")
    return col(wave).between(low * (1 + z), high * (1 + z))


def valid_sample(flux="flux", unc="unc", good=None) -> Column:
    ok = clean(flux).isNotNull() & (clean(unc) > 0)
    ok = ok if good is None else ok & col(good)
    return F.coalesce(ok, F.lit(False))


def positive_finite(value) -> Column:
    return F.coalesce(clean(value) > 0, F.lit(False))


def hard_masks(
    samples: DataFrame, keys: Sequence[str] = ("target_id", "arm"), *, w0: float | None = None, w1: float | None = None, reject_flags: bool = False,
    min_good_fraction: float = 0.5, bad_channel_fraction: float = 0.5, has_exposure: bool = True,
) -> DataFrame:
    """The mask algebra: adds instrument_good, covered, base_good, coverage_fraction, good_fraction, bad_fraction, good_wave, good_spaxel, good.

    Fractions of a spaxel are over instrument-good channels; a channel's bad fraction is over
    the core footprint only, so padding never counts. Low signal to noise rejects nothing.
    """
    keys = list(keys)
    wave = clean("wave")
    instrument = wave.isNotNull() & (wave >= (w0 if w0 is not None else float("-inf"))) & (wave <= (w1 if w1 is not None else float("inf")))
    measured = valid_sample("flux", "unc")
    covered = F.coalesce(clean("exposure") > 0, F.lit(False)) if has_exposure else measured
    base = covered & measured & ~F.coalesce("mask", F.lit(False))
    if reject_flags:
        base = base & (F.coalesce("flags", F.lit(0)) == 0)
    rows = samples.withColumns({"instrument_good": instrument, "covered": covered, "base_good": base})
    share = lambda c: F.avg(F.when(F.col("instrument_good"), F.col(c).cast("int")))
    spaxels = rows.groupBy(*keys, "y", "x").agg(F.coalesce(share("covered"), F.lit(0.0)).alias("coverage_fraction"), F.coalesce(share("base_good"), F.lit(0.0)).alias("good_fraction"))
    whole = spaxels.groupBy(*keys).agg(
        F.max((F.col("coverage_fraction") >= min_good_fraction).cast("int")).alias("any_core"), F.max("coverage_fraction").alias("best")
    )
    core = F.when(F.col("any_core") == 1, F.col("coverage_fraction") >= min_good_fraction).otherwise(F.col("coverage_fraction") > 0)
    empty = F.assert_true(F.col("best") > 0, "no spaxel is covered").isNull()
    spaxels = spaxels.join(small_side(whole), keys) if keys else spaxels.crossJoin(F.broadcast(whole))
    spaxels = spaxels.where(empty).withColumn("core", core).withColumn("good_spaxel", F.col("good_fraction") >= min_good_fraction)
    rows = rows.join(spaxels.drop("any_core", "best"), [*keys, "y", "x"])
    channels = rows.groupBy(*keys, "chan").agg(
        F.max("instrument_good").alias("chan_good"), (1.0 - F.avg(F.when(F.col("core"), F.col("base_good").cast("int")))).alias("bad_fraction")
    )
    channels = channels.withColumn("good_wave", F.col("chan_good") & (F.col("bad_fraction") <= bad_channel_fraction)).drop("chan_good")
    rows = rows.join(small_side(channels), [*keys, "chan"])
    return rows.withColumn("good", F.col("base_good") & F.coalesce("good_wave", F.lit(False)) & F.col("good_spaxel"))


def apply_range_masks(samples: DataFrame, ranges: DataFrame, support: tuple[float, float] | None = None) -> DataFrame:
    """Drops samples inside any closed range (lo, hi), given as a small table, or outside the support."""
    rows = samples if support is None else samples.where(F.col("wave").between(*support))
    r = F.broadcast(ranges.select(F.col("lo").alias("range_lo"), F.col("hi").alias("range_hi")))
    return rows.join(r, F.col("wave").between(F.col("range_lo"), F.col("range_hi")), "left_anti")


def window_coverage(channels: DataFrame, low: float, high: float, z: float = 0.0, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    """How well the good channels cover a requested window, per key; the window is never moved."""
    keys = list(keys)
    lo, hi = low * (1 + z), high * (1 + z)
    order = Window.partitionBy(*keys).orderBy("wave", "chan")
    good = F.when(F.col("good"), F.col("wave"))
    inside = F.col("wave").between(lo, hi)
    rows = channels.withColumn("step", F.lead("wave").over(order) - F.col("wave"))
    found = rows.groupBy(*keys).agg(
        F.min(good).alias("good_min"), F.max(good).alias("good_max"), F.percentile("step", F.lit(0.5)).alias("step"),
        F.count_if(inside).alias("n_requested"), F.count_if(inside & F.col("good")).alias("n_good"),
        F.min(F.when(inside, good)).alias("usable_min"), F.max(F.when(inside, good)).alias("usable_max"),
    )
    overlap = F.least(F.col("good_max"), F.lit(hi)) - F.greatest(F.col("good_min"), F.lit(lo))
    return found.where(F.assert_true(F.col("good_min").isNotNull(), "no good channel").isNull()).select(
        *keys, F.lit(lo).alias("requested_min"), F.lit(hi).alias("requested_max"), "good_min", "good_max",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), overlap / (hi - lo))).alias("envelope_fraction"),
        F.coalesce(F.try_divide("n_good", "n_requested"), F.lit(0.0)).alias("usable_channel_fraction"),
        (F.col("good_min") - lo > F.col("step") / 2).alias("truncated_blue"), (hi - F.col("good_max") > F.col("step") / 2).alias("truncated_red"),
        "usable_min", "usable_max", "n_requested", "n_good",
    )


def sn_qc(bins: DataFrame, *, min_channels: int = 5, extreme: float = 1e3, factor: float = 5.0) -> DataFrame:
    """Adds nonpositive, extreme and disagreement to per-bin signal-to-noise rows."""
    signed, legacy = F.col("signed"), F.col("legacy")
    large, small = F.greatest(F.abs("signed"), F.abs("legacy")), F.least(F.abs("signed"), F.abs("legacy"))
    both = signed.isNotNull() & legacy.isNotNull()
    no = F.lit(False)
    return bins.withColumns(
        {
            "nonpositive": F.coalesce((F.col("n_good") >= min_channels) & signed.isNotNull() & ~F.col("positive"), no),
            "extreme": F.coalesce(F.abs("signed") > extreme, no) | F.coalesce(F.abs("legacy") > extreme, no),
            "disagreement": F.coalesce(both & (large > 1) & (large > factor * F.greatest(small, F.lit(1e-12))), no),
        }
    )


def enough_pixels(spectra: DataFrame, least: int, keys: Sequence[str] = ("target_id", "arm", "bin_id")) -> DataFrame:
    """The keys with fewer than `least` good pixels."""
    return spectra.groupBy(*keys).agg(F.count_if("good").alias("n_good")).where(F.col("n_good") < least)


def aperture_clip_radius(x, y, rmax: float) -> Column:
    return F.coalesce(F.hypot(clean(x), clean(y)) <= rmax, F.lit(False))


def validate_spectrum(spectra: DataFrame, keys: Sequence[str], least: int = 5) -> DataFrame:
    """Per spectrum: how many rows break each rule, and whether it is valid."""
    order = Window.partitionBy(*keys).orderBy("chan")
    rows = spectra.withColumn("rises", F.col("wave") > F.lag("wave").over(order))
    found = rows.groupBy(*keys).agg(
        F.count_if("good").alias("n_good"), F.count_if(F.col("good") & ~valid_sample()).alias("n_invalid"), F.count_if(~F.col("rises")).alias("n_not_rising")
    )
    return found.withColumn("valid", (F.col("n_good") >= least) & (F.col("n_invalid") == 0) & (F.col("n_not_rising") == 0))
