"""What the training-data operators share: tables, written cuts of the lineage, splits."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Lists the folders that ``settle`` writes inside the block, so that the caller can delete them."""
    token = _scratch.set(made := [])
    try:
        yield made
    finally:
        _scratch.reset(token)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def give_back() -> None:
    """Freed memory of this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with every C library
        pass


def shrink_executors(spark: SparkSession) -> None:
    """Executors collect their garbage, so that their heaps shrink to what is in use and leave room for the workers of what comes next.

    A heap once grown stays else, and counts beside the Python processes.
    """
    n = 1 if spark.sparkContext.master.startswith("local[") else spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def tidy(run):
    """``run`` over batches; when a task ends, its worker gives freed memory back, as it stays for others."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, without its lineage.

    What is lost with an executor is then read again from the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _scratch.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unsettle(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        delete(spark, files[0].rpartition("/")[0])


def free_shuffles(spark: SparkSession) -> None:
    """What frames that are gone have shuffled is deleted now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def no_nulls(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
