"""Box and ball range joins over closed regions, as plain theta joins.

boxes: qid, lo0 .., hi0 ..; balls: qid, q0 .., r; points: id, c0 ... These are the measure
of the pruned forms in ``quadrille.operators.cells``: every pair is compared, so regions
beyond ``MOST_REGIONS`` are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import coords, point_in_ball, point_in_box


def _inside_box(dim: int) -> Column:
    return point_in_box(coords(dim), coords(dim, "lo"), coords(dim, "hi"))


def _inside_ball(dim: int) -> Column:
    return point_in_ball(coords(dim), coords(dim, "q"), F.col("r"))


MOST_REGIONS = 200_000


def _few(regions: DataFrame) -> DataFrame:
    if regions.count() > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions: use the layout's joins")
    return regions


def _counted(regions: DataFrame, points: DataFrame, inside: Column) -> DataFrame:
    return _few(regions).join(points, inside, "left").groupBy("qid").agg(F.count("c0").alias("cnt"))


def count_in_boxes(boxes: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    """(qid, cnt), zero counts included."""
    return _counted(boxes, points, _inside_box(dim))


def count_in_balls(balls: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    return _counted(balls, points, _inside_ball(dim))


def report_boxes(boxes: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    """(qid, id, c0 ..): every point of every box, copies kept."""
    return _few(boxes).join(points, _inside_box(dim)).select("qid", "id", *coords(dim))


def report_balls(balls: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    return _few(balls).join(points, _inside_ball(dim)).select("qid", "id", *coords(dim))


def disagreements(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of (qid, cnt) that differ from (qid, expected); a query on one side only counts."""
    return counts.join(expected, "qid", "full").where(~F.col("cnt").eqNullSafe(F.col("expected"))).select("qid", "cnt", "expected")
