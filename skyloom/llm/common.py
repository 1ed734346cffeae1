"""What the operators of this subpackage share: scratch tables, text normalisation, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows whose texts are Python strings at one time in a task.
SLICE_ROWS = 500
#: Rows of a few numbers, so a few megabytes.
BROADCAST_ROWS = 100_000
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where the setting is absent, a local session takes one temporary folder,
    any other session a folder beside the warehouse tables.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        if spark.sparkContext.master.startswith("local"):
            _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            _own_dir[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own_dir[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back; cuts the lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, at_most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows for a join: broadcast while it has at most so many rows, beyond that sorted and merged."""
    return F.broadcast(df) if df.count() <= at_most else df.hint("merge")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_text(text: str | Column) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def bounded_sample(rows: DataFrame, key: str, at_most: int) -> DataFrame:
    """At most `at_most` rows, those with the smallest hash of `key`; thinned first, so that few rows meet in one task."""
    share = min(1.0, 1.5 * at_most / max(1, rows.count()))
    thinned = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) <= int(share * (1 << 30)))
    return thinned.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(at_most)


def in_slices(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, *, done: Callable[[], None] | None = None) -> DataFrame:
    """`work` on slices of at most SLICE_ROWS rows; `done` runs at the end of each task, to free what it has kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield work(batch.slice(at, SLICE_ROWS))
        if done:
            done()

    return rows.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def map_texts(
    rows: DataFrame, work: Callable[[list[str]], list[pa.Array]], fields: str, *, text: str = "the_text", keep_text: bool = False, done: Callable[[], None] | None = None
) -> DataFrame:
    """The rows with `fields` (as DDL) that `work` finds from their texts, null as empty.

    Only a slice of texts at a time becomes Python strings. All other columns pass as Arrow,
    so long ids stay exact beside nulls. The text is left out unless `keep_text`.
    """
    names = [c for c in rows.columns if keep_text or c != text]
    schema = StructType([rows.schema[c] for c in names] + StructType.fromDDL(fields).fields)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = [batch.column(c) for c in names] + work(texts_of(batch, text))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return in_slices(rows, add, schema, done=done)
