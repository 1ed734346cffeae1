"""The driver's tables as operator inputs: spectra, samples, images, events, surfaces, headers, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 50  # columns of the image


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64-channel spectra, the label as the bin."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("chan", "flux"))
    var = 0.01 + 0.002 * ((F.col("vec_id") * 7 + F.col("chan") * 3) % 11)
    return rows.select(
        F.lit("demo").alias("target_id"), F.lit("BL").alias("arm"), F.col("label").alias("bin_id"), F.col("vec_id").alias("spaxel"), "chan",
        (4800.0 + 10.0 * F.col("chan")).alias("wave"), F.col("flux").cast("double").alias("flux"), var.alias("var"), F.sqrt(var).alias("unc"),
        ((F.col("vec_id") + F.col("chan")) % 13 != 0).alias("good"),
    )


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples: suppliers are bins, parts are pixels, ship months are channels."""
    chan = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.lit("demo").alias("target_id"), F.lit("red").alias("arm"), F.col("l_suppkey").alias("bin_id"), F.col("l_partkey").alias("spaxel"),
        F.floor(F.col("l_partkey") / WIDTH).cast("long").alias("y"), (F.col("l_partkey") % WIDTH).alias("x"), chan.alias("chan"), (9000.0 + 10.0 * chan).alias("wave"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000).alias("flux"), F.col("l_quantity").alias("var"), F.sqrt("l_quantity").alias("unc"),
        (F.col("l_returnflag") == "R").alias("mask"), F.when(F.col("l_tax") > 0, 1.0).otherwise(0.0).alias("exposure"), F.lit(0).alias("flags"),
        F.col("l_linenumber").alias("linenumber"), F.round("l_discount", 2).alias("discount"), F.col("l_returnflag").alias("flag"),
    )


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an image of account balances; value2 is their summed orders."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("value2"))
    return c.join(o, "c_custkey", "left").select(
        F.lit("demo").alias("target_id"), F.lit("BL").alias("arm"), F.floor(F.col("c_custkey") / WIDTH).cast("int").alias("y"), (F.col("c_custkey") % WIDTH).cast("int").alias("x"),
        F.col("c_acctbal").alias("value"), "value2", F.col("c_nationkey").alias("bin_id"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3.6e9
    return t.select(F.col("event_type").alias("arm"), F.col("user_id").alias("spaxel"), "event_id", hours.alias("t"), "value", F.floor(hours / 24).cast("int").alias("day"))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three state surfaces of up to 7 x 11 x 9 cells."""
    t = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_returnflag").alias("bin_id"), (F.col("l_linenumber") - 1).cast("int").alias("ia"), F.round(100 * F.col("l_discount")).cast("int").alias("ib"), F.round(100 * F.col("l_tax")).cast("int").alias("jf")]
    found = t.groupBy(*keys).agg(F.round(F.avg("l_extendedprice") / 997.13, 10).alias("chi2"))
    return found.select(F.lit("demo").alias("target_id"), "bin_id", "ia", "ib", "jf", "chi2")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as header keys and values, one row per key."""
    p = table(spark, sf_dir, "part")
    keys = {"CTYPE": F.col("p_type"), "COMMENT": F.col("p_name"), "GRATING": F.col("p_brand"), "CWAVE": F.col("p_retailprice").cast("string")}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in keys.items()])
    return p.select(F.col("p_partkey").alias("file_id"), F.inline(pairs))


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as runs of targets, line numbers as their products."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return (
        o.select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("mtime")),
        li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("string").alias("product")),
    )


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
