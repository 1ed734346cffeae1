"""Resumable work as a file stream: each run takes what is new and replaces the partitions that it writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, partition: str = "target_id") -> StreamingQuery:
    """Run `work` over the source's files that no earlier run has seen, then stop.

    A batch that is repeated after a failure overwrites its own partitions, so results are whole and single.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consolidate_available(spark: SparkSession, checkpoints: str, schema: str, product: str, checkpoint: str, fingerprint: str) -> StreamingQuery:
    """Take the per-bin checkpoints that no earlier run has taken into one product, then stop.

    `checkpoints` is a folder of Parquet files with the states of one or more whole bins and the
    fingerprint of the settings that they were made with; states of other settings are left out.
    Each batch is one partition of the product, which a repeated batch replaces, so a run that
    was killed and started again gives the same product. `read_consolidated` reads it.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.where(F.col("fingerprint") == fingerprint).withColumn("batch", F.lit(number).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(product)

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(checkpoints)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_consolidated(spark: SparkSession, product: str, schema: str, keys: Sequence[str] = ("target_id", "bin_id")) -> DataFrame:
    """The states of every bin from the last batch that brought them: a bin that was fitted again replaces its older states."""
    keys = list(keys)
    rows = spark.read.schema(f"{schema}, batch long").parquet(product)
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).drop("batch")
