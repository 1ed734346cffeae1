"""The vocabulary of quality flags, as a small table that flag rows are joined with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of flags. The texts are this package's own.
FLAGS = {
    "GRID_EDGE_WARNING": "the chosen state lies near an edge of the parameter grid",
    "LOW_TWO_COMPONENT_SUPPORT": "mocks show little support for a second component",
    "OUTSIDE_TWO_SIGMA_REGION": "the bin lies beyond the radius of the primary model",
    "HIGH_BIN_SHEAR": "velocities vary so much within the bin that its centroid stands for it badly",
    "POOR_RING_COVERAGE": "a ring of the rotation curve is covered by too few data",
    "BL_JOINT_NOT_CONVERGED": "population draws reached their limit before they converged",
    "MC_NOT_CONVERGED": "Monte Carlo runs reached their limit before they converged",
    "AGE_GRID_EDGE_A": "weights of component A pile up at the youngest or oldest templates",
    "AGE_GRID_EDGE_B": "weights of component B pile up at the youngest or oldest templates",
    "METALLICITY_GRID_EDGE_A": "weights of component A pile up at the first or last metallicity",
    "METALLICITY_GRID_EDGE_B": "weights of component B pile up at the first or last metallicity",
    "RADIAL_EXTENT_DISAGREEMENT": "models of the inner and the whole aperture differ where both hold",
    "AMBIGUOUS_DISK_LABEL": "the components could not be told apart by their outer branches",
    "WAVELENGTH_CONVENTION_ERROR": "science and templates differ in medium or velocity frame",
    "BINNING_APERTURE_WARNING": "the aperture found for binning is unusually small",
    "BIN_TRANSFER_INCOMPLETE": "too few pixels of the second arm fall into the bins of the first",
    "LOW_BL_BIN_SN": "a bin's signal to noise is well below its target",
    "SPATIAL_COVARIANCE_UNCALIBRATED": "uncertainties leave out the covariance between pixels",
    "SN_WINDOW_COVERAGE_WARNING": "a window for signal to noise reaches beyond the good channels",
    "NONPOSITIVE_BIN_CONTINUUM": "a bin's median continuum is not positive",
    "EXTREME_BIN_SN_DIAGNOSTIC": "a bin's signal to noise is beyond the warning limit",
    "BIN_SN_ESTIMATOR_DISAGREEMENT": "two estimates of a bin's signal to noise differ by too large a factor",
    "RH3_LIKELIHOOD_WIDTH_UNCALIBRATED": "widths of the likelihood rest on formal uncertainties only",
    "RH3_ONE_COMPONENT_FAILURES": "a fit of one component failed",
    "RH3_GRID_FIT_FAILURES": "a state of the grid failed or is invalid",
    "RH3_SIGMA_BOUNDARY_STATES": "a state of the grid has a dispersion near its bounds",
    "RH3_FRACTION_CONSTRAINT_WARNING": "a best state's weights miss the fraction asked for",
}


def flag_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FLAGS.items()), "flag string, description string")


def describe_flags(flags: DataFrame) -> DataFrame:
    """Adds description; an unknown flag is an error."""
    found = flags.join(F.broadcast(flag_table(flags.sparkSession)), "flag", "left")  # a fixed table
    unknown = F.raise_error(F.concat(F.lit("unknown flag "), F.col("flag"))).cast("string")
    return found.withColumn("description", F.coalesce("description", F.when(F.col("flag").isNotNull(), unknown)))


def stage_flags(summary: DataFrame, tolerance: float, keys: tuple[str, ...] = ("target_id",)) -> DataFrame:
    """(keys, flag, n_bins) of the grid stage: fractions missed, failed single fits, failed states, states at a bound.

    `summary` has a row per bin: requested, achieved, one_component_ok, n_failed, n_boundary.
    """
    marks = {
        "RH3_FRACTION_CONSTRAINT_WARNING": F.abs(F.col("achieved") - F.col("requested")) > tolerance,
        "RH3_ONE_COMPONENT_FAILURES": ~F.col("one_component_ok"),
        "RH3_GRID_FIT_FAILURES": F.col("n_failed") > 0,
        "RH3_SIGMA_BOUNDARY_STATES": F.col("n_boundary") > 0,
    }
    counts = summary.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in marks.items()])
    each = F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("n_bins")) for k in marks])
    return counts.select(*keys, F.inline(each)).where("n_bins > 0")
