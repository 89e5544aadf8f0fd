"""Point views over the driver's tables, as frames and as the SQL of their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def parts(spark, sf_dir) -> DataFrame:
    """id, size, price in cents."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("c0"), _cents("p_retailprice").alias("c1"))


def lines(spark, sf_dir) -> DataFrame:
    """quantity, price in cents, discount in percent; no id."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("c0"), _cents("l_extendedprice").alias("c1"), F.round(F.col("l_discount") * 100).cast("long").alias("c2"))


def customers(spark, sf_dir) -> DataFrame:
    """Points of another distribution: nation, balance in cents."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("c0"), _cents("c_acctbal").alias("c1"))


def order_years(spark, sf_dir) -> DataFrame:
    """period (year), id, day number, price in cents."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("period"), F.col("o_orderkey").alias("id"), day.alias("c0"), _cents("o_totalprice").alias("c1"))


def event_days(spark, sf_dir) -> DataFrame:
    """period (days since 1970), id, user, value in cents."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf_dir, "events").select(day.alias("period"), F.col("event_id").alias("id"), F.col("user_id").alias("c0"), _cents("value").alias("c1"))


SQL = {
    "pts": "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS c0, CAST(round(p_retailprice * 100) AS BIGINT) AS c1 FROM part",
    "lines": "SELECT CAST(l_quantity AS BIGINT) AS c0, CAST(round(l_extendedprice * 100) AS BIGINT) AS c1, CAST(round(l_discount * 100) AS BIGINT) AS c2 FROM lineitem",
    "cust": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS c0, CAST(round(c_acctbal * 100) AS BIGINT) AS c1 FROM customer",
    "years": "SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_orderkey AS id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS c0, CAST(round(o_totalprice * 100) AS BIGINT) AS c1 FROM orders",
    "days": "SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS period, event_id AS id, user_id AS c0, CAST(round(value * 100) AS BIGINT) AS c1 FROM events",
}


def with_views(body: str, *names: str) -> str:
    """``body`` after the views it reads; a body that begins with a view of its own goes on."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {views}{', ' if body.startswith('+') else ' '}{body.lstrip('+')}"
