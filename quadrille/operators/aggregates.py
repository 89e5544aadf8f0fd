"""Aggregates over bags of points (columns c0 .. c{dim-1})."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.sources.shared import settled

from quadrille.functions.geometry import widest_dimension


def bounding_box(points: DataFrame, dim: int, *keys: str) -> DataFrame:
    """lo0 .., hi0 ..; all null over no rows. With keys, a box for each."""
    return points.groupBy(*keys).agg(*[F.min(f"c{i}").alias(f"lo{i}") for i in range(dim)], *[F.max(f"c{i}").alias(f"hi{i}") for i in range(dim)])


def size(points: DataFrame) -> DataFrame:
    """Rows, copies included."""
    return points.agg(F.count(F.lit(1)).alias("cnt"))


def distinct_size(points: DataFrame, dim: int) -> DataFrame:
    return multiplicities(points, dim).agg(F.count(F.lit(1)).alias("cnt"))


def multiplicities(points: DataFrame, dim: int) -> DataFrame:
    """The run-length form: each distinct point with its number of copies."""
    return points.groupBy(*[f"c{i}" for i in range(dim)]).agg(F.count(F.lit(1)).alias("mult"))


def expanded(runs: DataFrame) -> DataFrame:
    """The bag of a run-length form."""
    return runs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "mult"))).drop("copy", "mult")


def widest(points: DataFrame, dim: int) -> DataFrame:
    box = bounding_box(points, dim)
    return box.select(widest_dimension([F.col(f"lo{i}") for i in range(dim)], [F.col(f"hi{i}") for i in range(dim)]).cast("long").alias("dim"))


def all_identical(points: DataFrame, dim: int) -> DataFrame:
    p = F.struct(*[f"c{i}" for i in range(dim)])
    return points.agg(F.coalesce(F.min(p) == F.max(p), F.lit(True)).alias("same"))


def upper_median(points: DataFrame, column: str) -> DataFrame:
    """The value at 0-based rank n div 2, by counts of values and their running sum.

    Values are counted first, so the ordered pass has a row for each distinct value in
    range partitions of its own; only partition totals meet.
    """
    counts = points.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = settled(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()), "aggregates-ranges")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("v"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ranged.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("n").over(inside))
    half = ranged.agg(F.floor(F.sum("n") / 2).alias("half"))
    return upto.join(F.broadcast(half)).where((F.col("upto") > F.col("half")) & (F.col("upto") - F.col("n") <= F.col("half"))).select(F.col("v").alias("median"))
