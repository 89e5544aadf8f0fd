"""Synthetic points, repeatable by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources.text import write_points


def unit_hash(*columns: Column) -> Column:
    """A double in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def uniform(spark: SparkSession, n: int, dim: int, low: int = 0, high: int = 1_000_000, seed: int = 1, whole: bool = True) -> DataFrame:
    """id from 0, c0 .. independent and uniform in [low, high]."""

    def draw(i: int) -> Column:
        u = unit_hash(F.lit(seed), F.lit(i), F.col("id"))
        return F.floor(u * (high - low + 1)).cast("long") + low if whole else u * (high - low) + low

    return spark.range(n).select("id", *[draw(i).alias(f"c{i}") for i in range(dim)])


def clustered(spark: SparkSession, n: int, dim: int, clusters: int = 10, extent: int = 1_000_000, seed: int = 1) -> DataFrame:
    """Clusters of very different density: each has its centre and a spread that grows with its number."""
    cluster = F.floor(unit_hash(F.lit(seed), F.lit("cluster"), F.col("id")) * clusters).cast("long")
    spread = F.lit(float(extent)) / F.pow(F.lit(2.0), F.lit(2.0) + F.col("cluster") % 12)

    def draw(i: int) -> Column:
        centre = unit_hash(F.lit(seed), F.lit("centre"), F.lit(i), F.col("cluster")) * extent
        # three uniform values: near a bell, of bounded reach
        off = sum((unit_hash(F.lit(seed), F.lit(k), F.lit(i), F.col("id")) for k in range(3)), F.lit(-1.5))
        return F.greatest(F.lit(0), F.least(F.lit(extent), F.floor(centre + off * spread))).cast("long")

    return spark.range(n).withColumn("cluster", cluster).select("id", *[draw(i).alias(f"c{i}") for i in range(dim)])


def write_files(spark: SparkSession, path: str, n: int, dim: int, files: int, kind: str = "uniform") -> None:
    """``path/n_dim/i.in`` for i from 1, each with a seed of its own."""
    make = {"uniform": uniform, "clustered": clustered}[kind]
    for i in range(1, files + 1):
        write_points(make(spark, n, dim, seed=i), f"{path}/{n}_{dim}/{i}.in", dim)
