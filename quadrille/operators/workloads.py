"""Query workloads: rectangles of a size bracket, pair boxes and balls, shifted clouds."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.geometry import coords, dist2
from quadrille.operators.zorder import sorted_by_key, with_scaled_key
from quadrille.sources.shared import settled
from quadrille.sources.text import with_row_index

# Brackets of a rectangle's number of points as powers of n; the points of a
# large table above which large rectangles hold at most a hundredth, and small ones.
BRACKETS = {"small": (0.0, 0.25), "medium": (0.25, 0.5), "large": (0.5, 1.0)}
LARGE_TABLE, LARGE_SHARE = 1_000_000, 100
WIDTH = 1024


def bracket(kind: str, n: int) -> tuple[int, int]:
    """The least and most points of a rectangle of ``n`` points' table."""
    low, high = BRACKETS[kind]
    if kind == "large":
        return max(1, int(n**low)), max(1, n // LARGE_SHARE if n > LARGE_TABLE else n - 1)
    return max(1, int(n**low)), max(1, int(n**high))


def rectangles(points: DataFrame, dim: int, kind: str, number: int, seed: int = 10, depth: int = 64) -> DataFrame:
    """(qid, lo0 .., hi0 .., expected): ``number`` boxes of random half-space cells, with their exact counts.

    The cells are made level by level: every cell of more rows than the bracket allows is cut
    at a random value on a random dimension (above goes right). A cell's rows are all the
    rows of its bounding box, so ``expected`` needs no second look. When nothing is left to
    cut, another random tree is begun from the root, until there are as many as asked; boxes
    may repeat across trees. Of a level's cells at most ``WIDTH`` are cut, which
    bounds what reaches the driver. A table that has no box of the bracket is an error.
    """
    spark = points.sparkSession
    draw = random.Random(seed)
    names = [f"c{i}" for i in range(dim)]
    rows_of = points.select(*names).dropna()
    low, high = bracket(kind, rows_of.count())
    found: list[tuple] = []
    for tree in range(number):
        before = len(found)
        table = rows_of.withColumn("node", F.lit("r"))
        for _ in range(depth):
            stats = table.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo{c[1:]}") for c in names], *[F.max(c).alias(f"hi{c[1:]}") for c in names])
            rows = sorted(stats.orderBy(F.desc("n"), "node").limit(2 * WIDTH).collect())
            found += [r for r in rows if low <= r.n <= high]
            cut = [r for r in rows if r.n > low and any(r[f"lo{i}"] < r[f"hi{i}"] for i in range(dim))]
            if len(found) >= number or not cut:
                break
            plan = []
            for r in sorted(cut, key=lambda r: (-r.n, r.node))[:WIDTH]:
                d = draw.choice([i for i in range(dim) if r[f"lo{i}"] < r[f"hi{i}"]])
                a, b = r[f"lo{d}"], r[f"hi{d}"]
                plan.append((r.node, d, float(a + (b - a) * draw.random())))
            cuts = spark.createDataFrame(plan, "node string, d int, at double")
            value = F.element_at(F.array(*[F.col(c).cast("double") for c in names]), F.col("d") + 1)
            table = table.join(F.broadcast(cuts), "node").withColumn("node", F.concat("node", F.when(value > F.col("at"), "1").otherwise("0"))).select(*names, "node")
        if len(found) >= number:
            break
        if len(found) == before and tree >= 8:
            raise ValueError(f"no rectangle of {low} to {high} points in {tree + 1} random trees")
    fields = [f"{s}{i}" for s in ("lo", "hi") for i in range(dim)]
    kinds = dict(points.dtypes)
    schema = ", ".join(["qid long", *[f"{f} {kinds['c' + f[2:]]}" for f in fields], "expected long"])
    return spark.createDataFrame([(k, *[r[f] for f in fields], r.n) for k, r in enumerate(found[:number])], schema)


def morton_rectangles(points: DataFrame, dim: int, number: int, size: int, bits: int = 20, seed: int = 10) -> DataFrame:
    """(qid, lo0 .., hi0 .., expected): boxes around runs of ``size`` points in Morton order, with ``expected`` points of the run at least.

    Runs begin at ``number`` random ranks; ranks come from counts of sorted ranges, so that
    no task sees all points. With fewer points than ``size`` each run has them all.
    """
    draw = random.Random(seed)
    n = points.count()
    starts = sorted(draw.randrange(max(1, n - size + 1)) for _ in range(number))
    keyed = with_scaled_key(points.dropna(subset=[f"c{i}" for i in range(dim)]), dim)
    ranked = with_row_index(settled(sorted_by_key(keyed), "workloads-morton"), "place")
    runs = points.sparkSession.createDataFrame([(k, s) for k, s in enumerate(starts)], "qid long, start long")
    inside = ranked.join(F.broadcast(runs), (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + size))
    return inside.groupBy("qid").agg(*[F.min(f"c{i}").alias(f"lo{i}") for i in range(dim)], *[F.max(f"c{i}").alias(f"hi{i}") for i in range(dim)], F.count(F.lit(1)).alias("expected"))


def paired(points: DataFrame, dim: int, n: int | None = None) -> DataFrame:
    """Each row i (ids 0 .. n-1) with row (i + n/2) mod n: qid, a0 .., b0 ..; one equi-join."""
    n = points.count() if n is None else n
    a = points.select(F.col("id").alias("qid"), *[F.col(f"c{i}").alias(f"a{i}") for i in range(dim)], F.pmod(F.col("id") + n // 2, F.lit(n)).alias("mate"))
    b = points.select(F.col("id").alias("mate"), *[F.col(f"c{i}").alias(f"b{i}") for i in range(dim)])
    return a.join(b, "mate").drop("mate")


def pair_boxes(points: DataFrame, dim: int, n: int | None = None) -> DataFrame:
    pairs = paired(points, dim, n)
    return pairs.select("qid", *[F.least(f"a{i}", f"b{i}").alias(f"lo{i}") for i in range(dim)], *[F.greatest(f"a{i}", f"b{i}").alias(f"hi{i}") for i in range(dim)])


def pair_balls(points: DataFrame, dim: int, n: int | None = None) -> DataFrame:
    """Centre row i, radius the distance to its mate, cut to a whole number for integers."""
    pairs = paired(points, dim, n)
    kind = dict(points.dtypes)["c0"]
    radius = F.sqrt(dist2(coords(dim, "a"), coords(dim, "b")).cast("double")).cast(kind)
    return pairs.select("qid", *[F.col(f"a{i}").alias(f"q{i}") for i in range(dim)], radius.alias("r"))


def as_queries(points: DataFrame, dim: int) -> DataFrame:
    return points.select(F.col("id").alias("qid"), *[F.col(f"c{i}").alias(f"q{i}") for i in range(dim)])


def shifted(queries: DataFrame, points: DataFrame, dim: int, widths: float) -> DataFrame:
    """Queries moved by a number of widths of the points' bounding box, dimension by dimension."""
    box = points.agg(*[(F.max(f"c{i}") - F.min(f"c{i}")).alias(f"w{i}") for i in range(dim)])
    return queries.join(F.broadcast(box)).select("qid", *[(F.col(f"q{i}") + F.col(f"w{i}") * widths).cast(dict(queries.dtypes)[f"q{i}"]).alias(f"q{i}") for i in range(dim)])


def cloud(spark: SparkSession, points: DataFrame, dim: int, n: int, widths: float, seed: int = 1) -> DataFrame:
    """n uniform query points in the data's box, moved by ``widths`` of its width."""
    box = points.agg(*[F.min(f"c{i}").cast("double").alias(f"lo{i}") for i in range(dim)], *[F.max(f"c{i}").cast("double").alias(f"hi{i}") for i in range(dim)])
    width = lambda i: F.col(f"hi{i}") - F.col(f"lo{i}")
    return spark.range(n).join(F.broadcast(box)).select(F.col("id").alias("qid"), *[(F.col(f"lo{i}") + width(i) * (F.rand(seed + i) + widths)).alias(f"q{i}") for i in range(dim)])
