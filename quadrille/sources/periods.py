"""Timestamped positions from CSV, by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.replay import deduplicated_slice


def read_positions(spark: SparkSession, path: str, start: str = "2014-01-01", end: str = "2024-01-01") -> DataFrame:
    """A CSV of id, ts, lon, lat: distinct rows of the slice with year and month."""
    rows = spark.read.schema("id bigint, ts timestamp_ntz, lon double, lat double").csv(path, header=True)
    return deduplicated_slice(rows, ["id", "ts", "lon", "lat"], "ts", start, end)


def write_periods(rows: DataFrame, path: str) -> None:
    """A folder for each year and month."""
    rows.repartition("year", "month").write.partitionBy("year", "month").parquet(path)


def as_periods(rows: DataFrame, monthly: bool = False) -> DataFrame:
    period = F.col("year") * 100 + F.col("month") if monthly else F.col("year")
    return rows.select(period.cast("int").alias("period"), "id", F.col("lon").alias("c0"), F.col("lat").alias("c1"))
