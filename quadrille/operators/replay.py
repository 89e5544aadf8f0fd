"""Periods of points and the window of the last few: what a replay holds after each period."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.geometry import coords, dist2
from quadrille.operators.cells import CellTable
from quadrille.operators.knn import in_blocks, top_k
from quadrille.sources.shared import settled

WINDOW = 5
MOST_APART = 1 << 30  # the squares of all coordinates stay in 64 bits


def period_counts(periods: DataFrame) -> DataFrame:
    return periods.groupBy("period").agg(F.count(F.lit(1)).alias("cnt"))


def deduplicated_slice(rows: DataFrame, keys: list[str], ts: str, start: str, end: str) -> DataFrame:
    """Distinct rows of [start, end) with their year and month."""
    t = F.col(ts)
    kept = rows.dropDuplicates(keys).where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))
    return kept.withColumn("year", F.year(t)).withColumn("month", F.month(t))


def _live_at(periods: DataFrame, length: int) -> DataFrame:
    """(period, at_period): the periods at whose end a period is live, its own and the next few that exist.

    Periods are numbered in order, so a gap in the calendar doesn't lengthen the window.
    """
    numbers = periods.select("period").distinct().withColumn("number", F.row_number().over(Window.orderBy("period")))
    at = numbers.select(F.col("period").alias("at_period"), F.col("number").alias("at_number"))
    return numbers.withColumn("at_number", F.explode(F.sequence(F.col("number"), F.col("number") + length - 1))).join(at, "at_number").select("period", "at_period")


def live_rows(periods: DataFrame, length: int = WINDOW) -> DataFrame:
    """Each row once for each period at whose end it is live."""
    return periods.join(_live_at(periods, length), "period")


def window_counts(periods: DataFrame, length: int = WINDOW) -> DataFrame:
    """(at_period, cnt): live rows after each period, from the periods' counts alone."""
    counts = period_counts(periods)
    upto = Window.orderBy("period").rowsBetween(-(length - 1), Window.currentRow)
    return counts.select(F.col("period").alias("at_period"), F.sum("cnt").over(upto).alias("cnt"))


def window_knn(periods: DataFrame, queries: DataFrame, k: int, dim: int, length: int = WINDOW) -> DataFrame:
    """(at_period, qid, nid, dist2, rk): neighbours of fixed queries among the rows live after each period.

    A window's neighbours are among those of its periods, so each period is searched once. All
    periods are one layout: a period lies apart from the next, on a coordinate of its own, by
    more than any two rows or queries do, so a search stays in its period.
    """
    own, asks = [f"c{i}" for i in range(dim)], [f"q{i}" for i in range(dim)]
    # no period can be told apart so if coordinates are too large or not finite: then each row meets each query
    numbers = settled(periods.select("period").distinct().dropna().withColumn("number", F.row_number().over(Window.orderBy("period"))), "replay-periods")
    ends = lambda frame, names: frame.agg(*[f(c).alias(f"{c}{f.__name__}") for c in names for f in (F.min, F.max)]).first()
    held, asked, n = ends(periods, own), ends(queries, asks), numbers.count()
    if not n or any(v is None for v in (*held, *asked)):
        apart = 1
    elif not all(math.isfinite(v) for v in (*held, *asked)):
        apart = MOST_APART
    else:
        apart = math.isqrt(math.ceil(sum(max(abs(held[2 * i + 1] - asked[2 * i]), abs(asked[2 * i + 1] - held[2 * i])) ** 2 for i in range(dim)))) + 1
    if apart * n >= MOST_APART:
        pairs = in_blocks(queries, lambda q: periods.join(q).select("period", "qid", F.col("id").alias("nid"), dist2(coords(dim), coords(dim, "q")).alias("dist2")))
        of_period = top_k(pairs, k, "period").drop("rk")
    else:
        place = (F.col("number").cast("long") * F.lit(apart).cast("long"))
        layout = CellTable(periods.join(F.broadcast(numbers), "period").select("id", *own, place.alias(f"c{dim}")), dim + 1)
        each = settled(queries.select("qid", *asks).crossJoin(F.broadcast(numbers)).withColumn("search", F.monotonically_increasing_id()), "replay-searches")
        near = layout.knn(each.select(F.col("search").alias("qid"), *asks, place.alias(f"q{dim}")), k).where(F.col("dist2") < F.lit(apart).cast("long") * F.lit(apart).cast("long"))
        of_period = near.select(F.col("qid").alias("search"), "nid", "dist2").join(each.select("search", "period", "qid"), "search").select("period", "qid", "nid", "dist2")
    return top_k(of_period.join(_live_at(periods, length), "period").drop("period"), k, "at_period")


def prefix_knn(points: DataFrame, queries: DataFrame, upto: int, k: int, dim: int) -> DataFrame:
    """Neighbours among the first rows by id, ids from 0."""
    return CellTable(points.where(F.col("id") < upto), dim).knn(queries, k)


def balance(table, more: DataFrame, ratios: tuple[int, ...]) -> DataFrame:
    """(ratio, nodes, unbalanced): for each ratio, how many inner nodes an insert leaves unbalanced.

    ``table`` is a SpatialTable whose splits stay; a study of how far skewed batches go
    before a rebuild is due.
    """
    layout = table.insert(more).layout
    out = None
    for ratio in ratios:
        row = layout.imbalance(ratio).agg(F.lit(ratio).cast("long").alias("ratio"), F.count(F.lit(1)).alias("nodes"), F.count_if("unbalanced").alias("unbalanced"))
        out = row if out is None else out.unionAll(row)
    return out
