"""Connected components of a link table by alternating stars, all in DataFrames.

Each round links every node to the least node it sees (large star: larger neighbours;
small star: smaller ones). Only minima are aggregated, so a hub's links are combined
before the shuffle and are never gathered in one task. Each round is written to the
shared folder; the one before it is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import settle, unsettle

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): each node with a link, and the least node that it reaches.

    ``links`` has long columns a < b. No links give no rows.
    """
    now = settle(links.select("a", "b"), label)
    mark = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == mark or not state.n:
            break
        mark = state
        after = settle(_small_star(_large_star(now)), label)
        unsettle(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
