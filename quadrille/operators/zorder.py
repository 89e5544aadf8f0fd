"""Morton order: keys, ranks and a clustered layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import coords, morton_key, quantised
from quadrille.sources.text import with_row_index


def with_key(points: DataFrame, dim: int, bits: int | None = None) -> DataFrame:
    """A key ``z`` of integer coordinates that are not negative, or of any relative to the box."""
    bits = bits or 63 // dim
    return points.withColumn("z", morton_key(coords(dim), bits))


def with_scaled_key(points: DataFrame, dim: int, bits: int | None = None) -> DataFrame:
    bits = bits or min(31, 63 // dim)
    box = points.agg(*[F.min(f"c{i}").alias(f"lo{i}") for i in range(dim)], F.greatest(*[F.max(f"c{i}") - F.min(f"c{i}") for i in range(dim)], F.lit(0)).alias("extent"))
    scaled = points.join(F.broadcast(box))
    return scaled.withColumn("z", morton_key(quantised(coords(dim), coords(dim, "lo"), F.col("extent"), bits), bits)).drop(*[f"lo{i}" for i in range(dim)], "extent")


def sorted_by_key(points: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range partitions of the key, each sorted: neighbours in space are neighbours in files."""
    dealt = points.repartitionByRange(partitions, "z") if partitions else points.repartitionByRange("z")
    return dealt.sortWithinPartitions("z")


def runs(points: DataFrame, dim: int, size: int) -> DataFrame:
    """(run, cnt, lo .., hi ..): boxes of runs of ``size`` points in the order of key and id."""
    keyed = with_key(points, dim, min(31, 63 // dim))
    placed = with_row_index(keyed.repartitionByRange("z", "id").sortWithinPartitions("z", "id"), "place")
    corners = [f(f"c{i}").alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(dim)]
    return placed.groupBy(F.floor(F.col("place") / size).alias("run")).agg(F.count(F.lit(1)).alias("cnt"), *corners)
