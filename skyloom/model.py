"""Table shapes, and the two layouts of a sample table: one row per sample, or arrays per spaxel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean

KEYS = ("target_id", "arm")
SAMPLES = "target_id string, arm string, y int, x int, chan int, wave double, flux double, unc double, mask boolean, flags int, exposure double, good boolean"
HEADERS = "file_id string, key string, value string, comment string"
WCS = "target_id string, arm string, crval1 double, crval2 double, crpix1 double, crpix2 double, cd11 double, cd12 double, cd21 double, cd22 double"
MEMBERSHIP = "target_id string, arm string, y int, x int, bin_id int, weight double, match_distance double"
STATES = "target_id string, bin_id string, ia int, ib int, jf int, va double, vb double, fa double, chi2 double, status int, boundary boolean"


def nan_to_null(df: DataFrame) -> DataFrame:
    """All floating columns with NaN and infinities as NULL."""
    floating = {f.name for f in df.schema if f.dataType.simpleString() in ("float", "double")}
    return df.select(*[clean(c).alias(c) if c in floating else F.col(c) for c in df.columns])


def to_arrays(samples: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key, an array per value in the given order; a spaxel's channels are bounded by the detector."""
    packed = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("rows"))
    return packed.select(*keys, *[F.col(f"rows.{c}").alias(c) for c in (order, *values)])


def to_samples(spectra: DataFrame, keys: list[str], values: list[str], order: str = "chan") -> DataFrame:
    """One row per array element."""
    zipped = F.arrays_zip(*values)
    return spectra.select(*keys, F.posexplode(zipped).alias(order, "row")).select(*keys, order, *[F.col(f"row.{v}").alias(v) for v in values])
