"""Intermediate tables of iterative operators, written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a temporary folder of a local session or one beside the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        local = spark.sparkContext.master.startswith("local")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet and read back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """A table with a row per target or channel, for a join: written, so that the planner knows its size, and broadcast only below the planner's limit."""
    return materialize(df, "side")
