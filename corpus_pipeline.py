"""The corpus pipeline: five stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame over all that the stage
before it kept; all but the last return the columns of ``documents``, with any others the
table has.

Defined results: a null text is an empty one for every decision and stays null in a stage
that keeps it; rows without an id, repeated ids and repeated rows are judged by their texts,
and of rows with equal or near-equal texts one stays; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, nearcopies, packing, pii, quality
from quadrille.llm.common import delete, give_back, scratch, settle, shrink_executors, table


#: Rows in a batch between Spark and its Python workers, so that long texts don't pile up in an executor.
BATCH_ROWS = 1_000


def _batched(spark: SparkSession, docs: DataFrame) -> DataFrame:
    give_back()  # what the driver held in the stage before
    shrink_executors(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(_batched(spark, docs), table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with 5-shingle similarity 0.8 or more stays, that of the least id: by SimHash, then exactly."""
    return nearcopies.keep_one(_batched(spark, docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contamination(_batched(spark, docs), table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to the names of their kinds; all documents stay."""
    return pii.redact(_batched(spark, docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(_batched(spark, docs))


STAGES = [
    ("quality", quality_stage),
    ("simhash", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# A trained classifier, hashes of shingles and a tokenizer's ids are beyond SQL; the stages
# are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself goes when its result is written."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as made:
            docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for path in [*held, *made[:-1]]:
            delete(spark, path)
        held = made[-1:]
    return docs
