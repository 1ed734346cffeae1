"""The corpus pipeline: documents through five stages, each over all that the one before kept.

Every stage takes a table with the columns of documents, of which any may be null but none may be
absent; other columns are left behind. An empty table passes through all stages as one. Rows that
repeat, ids included, are rows of their own until a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.common import DOC_COLUMNS, materialize, read_table
from skyloom.llm.exact_dedup import exact_dedup
from skyloom.llm.near_dedup import keep_one_of_each
from skyloom.llm.packing import pack_documents
from skyloom.llm.pii import sanitise_documents
from skyloom.llm.quality_rules import keep_good
from skyloom.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What a batch of texts on its way to Python may hold. The session keeps it, as the stage's result is written by the caller.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def in_small_batches(stage: Stage) -> Stage:
    """The stage with its texts going to Python in small batches: five stages share the executors' memory."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCH.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go. Null and empty texts have no words and go; ids do not matter but for the labels."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


@in_small_batches
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, exactly one row on ties; null texts are empty ones, null ids the smallest."""
    return exact_dedup(docs, payload=DOC_COLUMNS[1:]).where("kept").select(*DOC_COLUMNS)


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest doc_id stays; where all ids are null, the text of the least hash. Texts without words all stay."""
    return keep_one_of_each(docs)


@in_small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it give way to their kind, n_chars is recounted where text changed; all rows stay, null texts null."""
    return sanitise_documents(docs)


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in packed sequences; a null or empty text is a piece of the end id alone."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]
#: No SQL: the rules, the sketches and the tokeniser are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
