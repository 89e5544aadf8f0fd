"""Result lines of benchmark runs: merging and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(lines: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """The mean of each measure over runs of equal keys; -1 means unavailable and is left out."""
    return lines.groupBy(*keys).agg(*[F.avg(F.when(F.col(m) != -1, F.col(m))).alias(m) for m in measures])


def mean_and_max(lines: DataFrame, key: str, measures: list[str]) -> DataFrame:
    return lines.groupBy(key).agg(*[f(m).alias(f"{n}_{m}") for m in measures for n, f in (("avg", F.avg), ("max", F.max))])
