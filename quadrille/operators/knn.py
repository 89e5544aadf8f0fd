"""k-nearest-neighbour joins by full comparison.

For high dimensions, where no cell can be left out, and as the measure of the pruned join
in ``quadrille.operators.cells``. Ties go to the smaller id. The smaller side is the
queries; they are broadcast in blocks of a fixed number of rows. Where ids are whole numbers
and coordinates all whole or all double, a task holds the k closest of each query so far and
gives these alone; rows with a null coordinate are no neighbour there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.geometry import array_dist2, coords, dist2

QUERY_BLOCK = 10_000
CHUNK, PAIRS_TASK, MOST_TASKS = 16, 1 << 30, 2_048


def top_k(pairs: DataFrame, k: int, *keys: str) -> DataFrame:
    """(qid, nid, dist2, rk): the k closest of each qid (and further keys), by (dist2, nid); planned as a partial and a final limit."""
    order = Window.partitionBy(*keys, "qid").orderBy("dist2", "nid")
    return pairs.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).withColumn("rk", F.col("rk").cast("long"))


def in_blocks(queries: DataFrame, pair: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Union of joins with blocks of queries, each small enough to broadcast."""
    n = -(-queries.count() // QUERY_BLOCK) or 1
    out = None
    for b in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b)
        pairs = pair(F.broadcast(part))
        out = pairs if out is None else out.unionAll(pairs)
    return out


def brute_knn(queries: DataFrame, points: DataFrame, k: int, dim: int, exclude_self: bool = False) -> DataFrame:
    """queries: qid, q0 ..; points: id, c0 ... With ``exclude_self`` a row doesn't meet its own id."""
    own, asks = coords(dim), coords(dim, "q")
    kinds, asked = dict(points.dtypes), dict(queries.dtypes)
    numbers = {kinds[f"c{i}"] for i in range(dim)} | {asked[f"q{i}"] for i in range(dim)}
    if numbers in ({"bigint"}, {"double"}) and {kinds["id"], asked["qid"]} <= {"int", "bigint"}:
        points = points.select("id", *own).dropna(subset=[f"c{i}" for i in range(dim)])
        n = queries.count()
        narrow = pa.int32() if kinds["id"] == "int" else pa.int64()
        tasks = min(MOST_TASKS, -(-points.count() * n // PAIRS_TASK))
        points = points.repartition(tasks) if tasks > 1 else points
        schema = f"qid {asked['qid']}, nid {kinds['id']}, dist2 {numbers.pop()}"
        return top_k(in_blocks(queries, lambda q: points.mapInArrow(_closest(q.select("qid", *asks).dropna(subset=[f"q{i}" for i in range(dim)]), k, dim, exclude_self, narrow), schema)), k)
    distance = dist2(own, asks)
    keep: Column = (F.col("id") != F.col("qid")) if exclude_self else F.lit(True)
    return top_k(in_blocks(queries, lambda q: points.join(q, keep).select("qid", F.col("id").alias("nid"), distance.alias("dist2"))), k)


class Closest:
    """The k closest of each query among the points seen so far, by distance and id."""

    def __init__(self, q: np.ndarray, qid: np.ndarray | None, k: int):
        self.q, self.qid, self.k = q, qid, k
        self.value, self.id = np.zeros((len(q), k), q.dtype), np.zeros((len(q), k), np.int64)
        self.held = np.zeros(len(q), np.int64)

    def _distances(self, part: slice, x: np.ndarray) -> np.ndarray:
        q, whole = self.q[part], self.q.dtype.kind == "i"
        if whole:
            most = sum(max(abs(int(a.max()) - int(b.min())), abs(int(b.max()) - int(a.min()))) ** 2 for a, b in zip(q.T, x.T))
            if most >= 1 << 63 and (((q[:, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2) >= 2.0**63).any():
                raise ArithmeticError("[ARITHMETIC_OVERFLOW] a squared distance exceeds 64 bits")
        out = None
        for a, b in zip(q.T, x.T):
            d = a[:, None] - b[None]
            d *= d
            out = d if out is None else np.add(out, d, out=out)
        return out

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        need = min(self.k + (self.qid is not None), len(x))
        for at in range(0, len(self.q) if len(x) else 0, CHUNK):
            part = slice(at, at + CHUNK)
            d, held = self._distances(part, x), self.held[part]
            edge, short = self.value[part, -1].copy(), held < self.k
            if short.any():  # all that it holds stays, so the closest of this batch are enough
                edge[short] = np.partition(d[short], need - 1, axis=1)[:, need - 1]
            near = ~(d > edge[:, None])
            if self.qid is not None:
                near &= ids[None] != self.qid[part][:, None]
            row, col = np.nonzero(near)
            if not len(row):
                continue
            old, place = np.nonzero(np.arange(self.k)[None] < held[:, None])
            row = np.concatenate([row, old])
            value = np.concatenate([d[near], self.value[part][old, place]])
            found = np.concatenate([ids[col], self.id[part][old, place]])
            best = np.lexsort((found, value, row))
            row, value, found = row[best], value[best], found[best]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < self.k
            row, rank = row[keep], rank[keep]
            self.value[at + row, rank], self.id[at + row, rank] = value[keep], found[keep]
            self.held[part] = np.bincount(row, minlength=len(held))


def _closest(queries: DataFrame, k: int, dim: int, exclude_self: bool, narrow: pa.DataType):
    """What a task does: one block of queries against its points, batch by batch."""
    asked = queries.toArrow()
    q = np.stack([asked[f"q{i}"].to_numpy() for i in range(dim)], axis=1)
    sent = queries.sparkSession.sparkContext.broadcast((asked["qid"].to_numpy(), q))

    def run(batches):
        qid, q = sent.value
        closest = Closest(q, qid if exclude_self else None, k)
        for batch in batches:
            x = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(dim)], axis=1)
            closest.add(batch.column("id").to_numpy(zero_copy_only=False), x)
        row, place = np.nonzero(np.arange(k)[None] < closest.held[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(closest.id[row, place], narrow), pa.array(closest.value[row, place])], names=["qid", "nid", "dist2"])

    return run


def brute_knn_arrays(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """queries: qid, q (array); points: id, v (array)."""
    keep: Column = (F.col("id") != F.col("qid")) if exclude_self else F.lit(True)
    return top_k(in_blocks(queries, lambda q: points.join(q, keep).select("qid", F.col("id").alias("nid"), array_dist2(F.col("v"), F.col("q")).alias("dist2"))), k)


def kth_distance(neighbours: DataFrame) -> DataFrame:
    """The k-th squared distance of each query, the one value that ties leave alone."""
    return neighbours.groupBy("qid").agg(F.max("dist2").alias("kdist2"))


def knn_graph(neighbours: DataFrame) -> DataFrame:
    """Edges (src, dst, w) of a neighbour table; edges to self stay where the join has them."""
    return neighbours.select(F.col("qid").alias("src"), F.col("nid").alias("dst"), F.col("dist2").alias("w"))
