"""The products of the binning stage: the table of bins, maps of their values, spectra by arm and their correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.scalar import pixel_to_world
from skyloom.operators import aggregates as A
from skyloom.operators import joins as J
from skyloom.sources.prepared import require, write_table

BIN = ("target_id", "bin_id")
#: Of each arm: the name in `achieved_sn` and the name in the table.
SN_COLUMNS = {
    "sn": "sn", "signed": "sn_signed", "legacy": "sn_legacy", "median_flux": "median_flux", "median_unc": "median_unc", "min_unc": "min_unc", "n_good": "n_channels", "negative_fraction": "negative_fraction",
}
BIN_COLUMNS = (
    "bin_id", "npix_a", "npix_b", "area", "x_geom", "y_geom", "x_flux", "y_flux", "ra", "dec", *[f"{c}_{arm}" for c in SN_COLUMNS.values() for arm in "ab"], "power_sn", "capacity", "coverage", "single",
)


def master_bins(members_a: DataFrame, members_b: DataFrame, sn_a: DataFrame, sn_b: DataFrame, wcs: DataFrame, *, centre: tuple[float, float], scale: float, law: A.Law | None = None, keys: Sequence[str] = BIN) -> DataFrame:
    """The table of bins, one wide row each, every bin of image a's membership among them.

    `members_a`: keys, y, x, signal, noise; `members_b`: keys, a row a pixel; `sn_a`, `sn_b`: what
    `achieved_sn` gives for the arms' spectra; `wcs`: image a's, one row a target. Positions are in
    arcsec from `centre` (y, x), pixels `scale` arcsec wide; the light's centroid also as a sky position.
    """
    keys = list(keys)
    weighed = A.light_weights(members_a, keys)
    shape = A.bin_centroids(weighed, keys)
    shape = shape.join(wcs, "target_id")
    ra, dec = pixel_to_world("x_light", "y_light", {c: F.col(c) for c in J.WCS_COLUMNS})
    off = lambda c, at: ((F.col(c) - at) * scale)
    shape = shape.select(
        *keys, off("x_mean", centre[1]).alias("x_geom"), off("y_mean", centre[0]).alias("y_geom"), off("x_light", centre[1]).alias("x_flux"), off("y_light", centre[0]).alias("y_flux"), ra.alias("ra"), dec.alias("dec"),
    )
    sizes = A.bin_geometry(members_a, members_b, scale * scale, keys)
    sizes = sizes.where("n_a > 0").select(*keys, F.col("n_a").alias("npix_a"), F.col("n_b").alias("npix_b"), "area", "coverage")
    power = A.bin_capacity(members_a, keys, law).select(*keys, F.sqrt(F.greatest("capacity", F.lit(0.0))).alias("power_sn"), "capacity", (F.col("npix") == 1).alias("single"))
    rows = sizes.join(shape, keys, "left").join(power, keys, "left")
    for arm, sn in (("a", sn_a), ("b", sn_b)):
        rows = rows.join(sn.select(*keys, *[F.col(c).alias(f"{name}_{arm}") for c, name in SN_COLUMNS.items()]), keys, "left")
    return rows.select(*[k for k in keys if k not in BIN_COLUMNS], *BIN_COLUMNS)


def write_bins(bins: DataFrame, path: str) -> None:
    """The table of bins with all its columns; a rerun replaces the targets that it writes."""
    write_table(require(bins, ("target_id", *BIN_COLUMNS), "the table of bins").select("target_id", *BIN_COLUMNS), path)


def write_bin_products(path: str, membership: DataFrame, transferred: DataFrame, bins: DataFrame, spectra: DataFrame, correlation: DataFrame | None = None) -> None:
    """Tables under `path`: maps (image a's pixels with their bin's values, image b's with bin and distance), spectra by arm, and the correlation if there is one."""
    values = bins.select("target_id", "bin_id", F.col("sn_a").alias("bin_sn_a"), F.col("sn_b").alias("bin_sn_b"), F.col("area").alias("bin_area"))
    own = J.bin_values_on_map(membership.select("target_id", "y", "x", "bin_id"), values).withColumn("arm", F.lit("a"))
    other = transferred.select("target_id", "y", "x", "bin_id", "match_distance").withColumn("arm", F.lit("b"))
    write_table(own.unionByName(other, allowMissingColumns=True), f"{path}/maps", ("target_id", "arm"))
    columns = ("target_id", "arm", "bin_id", "chan", "wave", "flux", "unc", "good", "n_contrib")
    write_table(require(spectra, columns, "the spectra").select(*columns), f"{path}/spectra", ("target_id", "arm"))
    if correlation is not None:
        write_table(correlation.select("target_id", "arm", "lag", "correlation"), f"{path}/correlation", ("target_id", "arm"))
