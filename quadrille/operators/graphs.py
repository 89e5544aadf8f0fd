"""Graphs as edge tables (src, dst, w): CSR form, symmetric closure, degrees, frontier steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.sources.shared import settled

from quadrille.functions.geometry import in_circle
from quadrille.sources.text import with_row_index


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without loops."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def vertex_count(edges: DataFrame) -> DataFrame:
    """One more than the largest vertex; 0 without edges."""
    return edges.agg(F.coalesce(F.greatest(F.max("src"), F.max("dst")) + 1, F.lit(0)).cast("long").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def csr_offsets(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, start, degree) for every vertex: degrees and their exclusive running sum.

    The sum runs inside range partitions of vertices; only partition totals meet.
    """
    degree = vertices.select(F.col("src")).join(degrees(edges), "src", "left").select("src", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    ranged = settled(degree.repartitionByRange("src").sortWithinPartitions("src").withColumn("part", F.spark_partition_id()), "graphs-ranges")
    totals = ranged.groupBy("part").agg(F.sum("degree").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(before), "part")
    return out.select("src", (F.col("before") + F.sum("degree").over(inside) - F.col("degree")).alias("start"), "degree")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbours): sorted targets of each source."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def edges_of(adjacent: DataFrame) -> DataFrame:
    return adjacent.select("src", F.explode("neighbours").alias("dst"))


def consistent(edges: DataFrame, n: int) -> DataFrame:
    """Edges that leave [0, n); none in a proper graph."""
    return edges.where(~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1))


def with_weights(edges: DataFrame, seed: int = 1) -> DataFrame:
    """A repeatable weight in [0, 1) for each edge."""
    return edges.withColumn("w", F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(1 << 53)) / F.lit(float(1 << 53)))


def permuted(rows: DataFrame, seed: int = 1) -> DataFrame:
    """Rows in a repeatable random order, with it as ``place``."""
    order = [F.xxhash64(F.lit(seed), *rows.columns), *rows.columns]
    return with_row_index(rows.repartitionByRange(*order).sortWithinPartitions(*order), "place")


def frontier_step(frontier: DataFrame, edges: DataFrame, condition: Column | None = None, distinct: bool = True) -> DataFrame:
    """Targets of edges out of a vertex set (v) that meet a condition on ``dst``."""
    out = edges.join(frontier, F.col("src") == F.col("v"), "left_semi")
    out = out.where(condition) if condition is not None else out
    out = out.select(F.col("dst").alias("v"))
    return out.distinct() if distinct else out


def triangle_neighbours(triangles: DataFrame) -> DataFrame:
    """(tri, side, other): the triangle on the other side of each directed edge; no row on a border.

    triangles: tri, a, b, c, all in the same turn, so a shared edge runs in reverse.
    """
    sides = triangles.select("tri", F.posexplode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")), F.struct(F.col("c").alias("u"), F.col("a").alias("v")))).alias("side", "e"))
    sides = sides.select("tri", F.col("side").cast("long").alias("side"), F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    return sides.alias("x").join(sides.alias("y"), (F.col("x.u") == F.col("y.v")) & (F.col("x.v") == F.col("y.u"))).select("x.tri", "x.side", F.col("y.tri").alias("other"))


def delaunay_violations(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(tri, other): neighbours of which one holds the other's far corner in its circle.

    points: id, c0, c1; triangles: tri, a, b, c, counter-clockwise.
    """
    corner = lambda name: points.select(F.col("id").alias(name), F.col("c0").alias(f"{name}0"), F.col("c1").alias(f"{name}1"))
    placed = triangles.join(corner("a"), "a").join(corner("b"), "b").join(corner("c"), "c")
    at = lambda name: [F.col(f"{name}0"), F.col(f"{name}1")]
    far = triangles.select(F.col("tri").alias("other"), F.explode(F.array("a", "b", "c")).alias("d"))
    pairs = triangle_neighbours(triangles).select("tri", "other").join(placed, "tri").join(far, "other").where(~F.col("d").isin(F.col("a"), F.col("b"), F.col("c")))
    return pairs.join(corner("d"), "d").where(in_circle(at("a"), at("b"), at("c"), at("d"))).select("tri", "other")
