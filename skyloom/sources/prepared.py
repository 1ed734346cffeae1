"""Reading, assembling and writing prepared sample tables and the small calibration tables beside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean, poly_eval
from skyloom.model import nan_to_null
from skyloom.operators import aggregates as A
from skyloom.sources.scratch import materialize, small_side

REQUIRED = ("y", "x", "chan", "wave", "flux", "unc", "good", "good_spaxel")
STEP = 1


def require(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def with_bad_fraction(samples: DataFrame, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    """Per channel 1 - mean(good) over good spaxels, joined back as bad_fraction; one small row per channel."""
    keys = list(keys)
    channels = samples.groupBy(*keys, "chan").agg((1.0 - F.avg(F.when(F.col("good_spaxel"), F.col("good").cast("int")))).alias("bad_fraction"))
    return samples.join(small_side(channels), [*keys, "chan"])


def read_prepared(spark: SparkSession, path: str, arm: str) -> DataFrame:
    """Prepared samples of one arm: required columns and the step stamp are checked, missing numbers become NULL."""
    df = require(spark.read.parquet(path), (*REQUIRED, "step", "arm"), "the prepared table").where(F.col("arm") == arm)
    df = df.where(F.assert_true(F.col("step") == STEP, "the table is of another step").isNull())
    return with_bad_fraction(nan_to_null(df).withColumn("base_good", F.col("good")))


def write_prepared(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    stamped = require(samples, REQUIRED, "the samples").withColumn("step", F.lit(STEP))
    stamped.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("target_id", "arm").parquet(path)


def assemble_companions(flux: DataFrame, var: DataFrame, mask: DataFrame, exposure: DataFrame, keys: Sequence[str] = ("target_id", "arm", "y", "x", "chan")) -> DataFrame:
    """Four matched tables (keys, value) as one: unc is the root of a positive variance, else NULL.

    Mask values other than 0 and 1, and negative variance inside the coverage, are errors.
    """
    keys = list(keys)
    part = lambda d, name: d.select(*keys, clean("value").alias(name))
    rows = part(flux, "flux").join(part(var, "var"), keys).join(part(mask, "m"), keys).join(part(exposure, "exposure"), keys)
    fine = F.col("m").isin(0.0, 1.0) & ~((F.col("var") < 0) & (F.col("exposure") > 0) & (F.col("m") == 0))
    rows = rows.where(F.assert_true(F.coalesce(fine, F.lit(True)), "mask or variance out of range").isNull())
    return rows.select(*keys, "flux", "var", F.when(F.col("var") > 0, F.sqrt("var")).alias("unc"), (F.col("m") == 1).alias("mask"), "exposure")


def assemble_extensions(primary: DataFrame, uncert: DataFrame, mask: DataFrame | None = None, flags: DataFrame | None = None, nosky: DataFrame | None = None, keys: Sequence[str] = ("target_id", "arm", "y", "x", "chan")) -> DataFrame:
    keys = list(keys)
    rows = primary.select(*keys, clean("value").alias("flux")).join(uncert.select(*keys, clean("value").alias("unc")), keys)
    for name, part in (("mask", mask), ("flags", flags), ("nosky", nosky)):
        if part is not None:
            rows = rows.join(part.select(*keys, F.col("value").alias(name)), keys, "left")
    rows = rows.withColumn("mask", F.coalesce(F.col("mask").cast("boolean"), F.lit(False)) if mask is not None else F.lit(False))
    return rows.withColumn("var", F.col("unc") * F.col("unc")).withColumn("flags", F.col("flags") if flags is not None else F.lit(None).cast("int"))


def read_templates(spark: SparkSession, path: str, meta_path: str | None = None) -> DataFrame:
    """(template_id, pix, wave, value, fwhm); a missing width is its template's median, else that of all; age and metallicity where the counts agree."""
    df = require(spark.read.parquet(path), ("template_id", "pix", "wave", "value", "fwhm"), "the template table")
    own = small_side(df.groupBy("template_id").agg(A.median("fwhm").alias("own")))  # one template's pixels
    typical = A.exact_percentiles(df, (), "fwhm", {"typical": 0.5}).select("typical")
    df = df.join(own, "template_id").crossJoin(F.broadcast(typical)).withColumn("fwhm", F.coalesce("fwhm", "own", "typical")).drop("own", "typical")  # one row
    return df if meta_path is None else df.join(small_side(spark.read.parquet(meta_path)), "template_id", "left")


def read_bin_spectra(spark: SparkSession, path: str, arm: str, n_bins: int | None = None) -> DataFrame:
    df = require(spark.read.parquet(path), ("target_id", "bin_id", "chan", "flux", "unc", "good"), "the bin spectra").where(F.col("arm") == arm)
    if n_bins is not None and df.select("target_id", "bin_id").distinct().count() != n_bins:
        raise ValueError("the spectra and the bin table differ in their bins")
    return nan_to_null(df)


def misplaced_coordinates(coordinates: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels without a coordinate; an empty table means that the shapes agree."""
    return pixels.select("target_id", "y", "x").join(coordinates.select("target_id", "y", "x"), ["target_id", "y", "x"], "left_anti")


#: Column names of width products, the current one first.
WIDTH_COLUMNS = {
    "coeffs": ("coeffs", "polynomial_coefficients", "poly_coefficients", "coefficients"),
    "lo": ("support_min", "measurement_wavelength_min", "empirical_wavelength_min", "empirical_wave_min", "empirical_min", "wave_min"),
    "hi": ("support_max", "measurement_wavelength_max", "empirical_wavelength_max", "empirical_wave_max", "empirical_max", "wave_max"),
    "grid_wave": ("model_wavelength", "model_wave", "wavelength_model", "wavelength_grid", "wave_grid"),
    "grid_fwhm": ("model_fwhm", "fwhm_model", "fwhm_grid"),
    "line_wave": ("wavelength", "line_wavelength", "line_wavelengths", "accepted_wavelength", "wavelengths"),
    "line_fwhm": ("fwhm_angstrom", "line_fwhm", "line_fwhms", "accepted_fwhm", "fwhm_values"),
}


def line_width_table(models: DataFrame, n: int = 2048, order: int = 2, keys: Sequence[str] = ("target_id", "arm")) -> DataFrame:
    """(keys, wave, fwhm, form) of width models, whichever form a row has; never beyond its support.

    1, polynomial: coefficients with both ends of their support, sampled on `n` points.
    2, grid: two arrays of one length, four samples at least.
    3, lines: arrays of accepted lines, enough for a polynomial of the order, which is fitted and sampled.
    The support of 2 and 3 is the one given, else that of the lines, else that of the grid. A row
    without a form, with an empty support or with fewer than four positive widths in it is an error.
    """
    keys, has = list(keys), set(models.columns)
    types = {"coeffs": "array<double>", "lo": "double", "hi": "double"}
    pick = lambda c: F.coalesce(*[F.col(x).cast(types.get(c, "array<double>")) for x in WIDTH_COLUMNS[c] if x in has], F.lit(None).cast(types.get(c, "array<double>")))
    rows = models.select(*keys, *[pick(c).alias(c) for c in WIDTH_COLUMNS])
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    pairs = lambda a, b: F.filter(F.zip_with(a, b, lambda w, v: F.struct(w.alias("wave"), v.alias("fwhm"))), lambda x: finite(x["wave"]) & finite(x["fwhm"]) & (x["fwhm"] > 0))
    matched = lambda a, b: F.coalesce(F.size(a) == F.size(b), F.lit(False))
    lines = F.when(matched("line_wave", "line_fwhm"), pairs("line_wave", "line_fwhm"))
    rows = rows.withColumn("lines", lines).withColumn("lines", F.when(F.size("lines") >= max(4, order + 2), F.col("lines")))
    rows = rows.withColumn("grid", F.when(matched("grid_wave", "grid_fwhm") & (F.size("grid_wave") >= 4), pairs("grid_wave", "grid_fwhm")))
    form = F.when(F.col("coeffs").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull(), "polynomial").when(F.col("grid").isNotNull(), "grid").when(F.col("lines").isNotNull(), "lines")
    rows = rows.withColumn("form", form).where(F.assert_true(F.col("form").isNotNull(), "a width product has no usable form").isNull())
    given = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    samples = F.coalesce("lines", "grid")
    end = lambda c, f: F.when(given, F.col(c)).otherwise(f(F.transform(samples, lambda x: x["wave"])))
    rows = materialize(rows.withColumns({"lo": end("lo", F.array_min), "hi": end("hi", F.array_max)}), "width-models")
    sound = F.coalesce((F.col("lo") < F.col("hi")) & ~F.exists(F.coalesce("coeffs", F.array()), lambda c: ~finite(c)), F.lit(False))
    rows = rows.where(F.assert_true(sound, "invalid support or coefficients").isNull())

    lined = rows.where("form = 'lines'").select(*keys, "lo", "hi", F.inline("lines"))
    fits = A.robust_polyfit(lined, order, rounds=0, keys=keys, x="wave", y="fwhm").select(*keys, "coeffs", F.col("x_mean").alias("x0"))
    smooth = rows.where("form = 'polynomial'").select(*keys, "form", "lo", "hi", "coeffs", F.lit(0.0).alias("x0"))
    smooth = smooth.unionByName(rows.where("form = 'lines'").select(*keys, "form", "lo", "hi").join(fits, keys))
    points = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / F.lit(float(n - 1)))
    sampled = smooth.select(*keys, "form", "lo", "hi", "coeffs", "x0", F.explode(points).alias("wave"))
    sampled = sampled.select(*keys, "form", "lo", "hi", "wave", poly_eval("coeffs", F.col("wave") - F.col("x0")).alias("fwhm"))
    saved = rows.where("form = 'grid'").select(*keys, "form", "lo", "hi", F.inline_outer("grid"))
    every = sampled.unionByName(saved)
    good = (F.col("fwhm") > 0) & F.col("wave").between(F.col("lo"), F.col("hi"))
    sizes = every.groupBy(*keys).agg(F.count_if(good).alias("n_good"))
    sizes = sizes.where(F.assert_true(F.col("n_good") >= 4, "fewer than four positive widths in the support").isNull())
    return every.where(good).join(materialize(sizes, "width-sizes"), keys).select(*keys, "wave", "fwhm", "form")


def profile_tables(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, int]]:
    """(table, column, type, rows) of every component; one count each."""
    return [(name, c, kind, n) for name, df in tables.items() for n in (df.count(),) for c, kind in df.dtypes]


def arc_pixels(arc: DataFrame, wave: DataFrame, slices: DataFrame, pos: DataFrame, keys: Sequence[str] = ("arc_id", "y", "x")) -> DataFrame:
    """(keys, value, wave, slice_id, pos): four frames of one shape; a missing partner is an error."""
    keys = list(keys)
    rows = arc.select(*keys, "value")
    for name, part in (("wave", wave), ("slice_id", slices), ("pos", pos)):
        rows = rows.join(part.select(*keys, F.col("value").alias(name), F.lit(True).alias(f"has_{name}")), keys, "left")
    whole = F.col("has_wave") & F.col("has_slice_id") & F.col("has_pos")
    return rows.where(F.assert_true(F.coalesce(whole, F.lit(False)), "the maps differ in shape").isNull()).select(*keys, "value", "wave", "slice_id", "pos")


def consolidated(states: DataFrame, one_component: DataFrame, keys: Sequence[str] = ("target_id", "bin_id"), axes: Sequence[str] = ()) -> DataFrame:
    """Per bin its best two-component chi2 and where it is, its one-component chi2, their difference, and counts of failed states."""
    keys = list(keys)
    best = states.groupBy(*keys).agg(
        F.min(clean("chi2")).alias("chi2_two"), F.count("*").alias("n_states"), F.count_if(clean("chi2").isNull()).alias("n_failed"),
        *([F.min(F.when(clean("chi2").isNotNull(), F.struct(clean("chi2").alias("c"), *axes))).alias("at")] if axes else []),
    )
    best = best.select(*keys, "chi2_two", "n_states", "n_failed", *[F.col(f"at.{a}").alias(a) for a in axes])
    return best.join(one_component.select(*keys, F.col("chi2").alias("chi2_one")), keys, "left").withColumn("delta", F.col("chi2_one") - F.col("chi2_two"))


def write_lines(fits: DataFrame, path: str) -> None:
    fits.write.mode("errorifexists").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("target_id",)) -> None:
    """Idempotent per partition: a rerun replaces the partitions that it writes and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def diagnostic_report(bins: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Counts of valid, non-positive and extreme bins and the worst bin, per target."""
    worst: Column = F.min(F.when(F.col("legacy").isNotNull(), F.struct("legacy", "bin_id"))).alias("worst")
    return bins.groupBy(*keys).agg(F.count("*").alias("n_bins"), F.count("sn").alias("n_valid"), F.count_if("nonpositive").alias("n_nonpositive"), F.count_if("extreme").alias("n_extreme"), worst)
