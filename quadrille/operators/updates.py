"""Batch-dynamic point tables: bag unions and bag differences.

A table is immutable; each update gives a new one. Deletes take one occurrence for each
row. The strict form raises if a row to delete isn't there; the lenient form leaves it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.cells import CellTable
from quadrille.sources.shared import settled

BROADCAST_ROWS = 1_000_000


class AbsentPoints(ValueError):
    """Rows of a strict delete that the table doesn't have."""


def insert(table: DataFrame, more: DataFrame) -> DataFrame:
    return table.unionByName(more)


def _batch(gone: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n_gone) of the rows to delete, broadcast if they are few by count."""
    counts = settled(gone.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_gone")), "updates-batch")
    return F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts


def _same(left: DataFrame, right: DataFrame, columns: list[str]):
    """Equal in all columns; nulls are equal."""
    return reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[c]) for c in columns])


def _held(table: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n_held): how often the table has the batch's rows; only these are counted."""
    found = table.alias("t").join(batch, _same(table, batch, columns), "left_semi")
    return found.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_held"))


def delete_lenient(table: DataFrame, gone: DataFrame) -> DataFrame:
    """One occurrence for each row of ``gone`` goes; what isn't there is left.

    The cost beyond a scan is that of the batch: rows that it doesn't name stay where they
    lie, and only those that it does are counted, copy by copy.
    """
    columns = table.columns
    batch = _batch(gone.select(*columns), columns)
    rest = table.join(batch, _same(table, batch, columns), "left_anti")
    held = _held(table, batch, columns)
    other = batch.select(*[F.col(c).alias(f"__{c}") for c in columns], "n_gone")
    kept = held.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])).where("n_held > n_gone")
    copies = kept.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_held") - F.col("n_gone"))).alias("__copy"))
    return rest.unionByName(copies.select(*columns))


def unmatched(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows to delete, copy by copy, that the table lacks."""
    columns = table.columns
    batch = _batch(gone.select(*columns), columns)
    other = _held(table, batch, columns).select(*[F.col(c).alias(f"__{c}") for c in columns], "n_held")
    lacks = batch.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]), "left").withColumn("n", F.col("n_gone") - F.coalesce("n_held", F.lit(0)))
    return lacks.where("n > 0").select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("__copy")).select(*columns)


def delete_strict(table: DataFrame, gone: DataFrame) -> DataFrame:
    absent = unmatched(table, gone).count()
    if absent:
        raise AbsentPoints(f"{absent} rows to delete aren't in the table")
    return delete_lenient(table, gone)


def delete_by_coordinates(table: DataFrame, gone: DataFrame, dim: int) -> DataFrame:
    """Take one row for each row of ``gone`` with equal coordinates, those of the least ids first.

    Both sides are counted by coordinates first; ranks are given among the copies of points
    that are deleted only.
    """
    from pyspark.sql import Window

    keys = [f"c{i}" for i in range(dim)]
    counts = gone.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gone"))
    order = Window.partitionBy(*keys).orderBy("id")
    touched = table.join(counts, keys)
    kept = touched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") > F.col("n_gone")).select(*table.columns)
    return table.join(counts, keys, "left_anti").select(*table.columns).unionByName(kept)


def fraction(table: DataFrame, ratio: float, n: int | None = None) -> DataFrame:
    """The first floor(n * ratio) rows by id, ids from 0."""
    n = table.count() if n is None else n
    return table.where(F.col("id") < int(n * ratio))


def slices(table: DataFrame, ratio: float, upto: float = 1.0) -> list[DataFrame]:
    """Batches of step * n rows by id, the last one shorter if need be."""
    n = table.count()
    step, end = max(1, int(n * ratio)), int(n * upto)
    return [table.where((F.col("id") >= at) & (F.col("id") < min(end, at + step))) for at in range(0, end, step)]


def _cut(table: DataFrame, k: int, every: int) -> DataFrame:
    return table.checkpoint() if every and k % every == every - 1 else table


def incremental_build(batches: Iterable[DataFrame], every: int = 8) -> DataFrame:
    """All batches, one after the other; the lineage is cut every few steps."""
    out = None
    for k, batch in enumerate(batches):
        out = batch if out is None else _cut(insert(out, batch), k, every)
    return out


def incremental_delete(table: DataFrame, batches: Iterable[DataFrame], strict: bool = False, every: int = 8) -> DataFrame:
    for k, batch in enumerate(batches):
        table = _cut((delete_strict if strict else delete_lenient)(table, batch), k, every)
    return table


class SpatialTable:
    """A point table with its layout; updates keep the splits until they no longer fit.

    An update changes the cells on record by the batch alone: an insert adds its counts and
    widens boxes, a delete takes its counts and leaves boxes as wide as they were.
    """

    def __init__(self, points: DataFrame, dim: int, layout: CellTable | None = None):
        self.points, self.dim = points, dim
        self.layout = layout or CellTable(points, dim)

    def _with(self, points: DataFrame, batch: DataFrame, sign: int) -> SpatialTable:
        old = self.layout
        change = CellTable(batch, self.dim, split=old.split).cells.withColumn("cnt", F.col("cnt") * sign)
        if sign < 0:  # what leaves doesn't narrow a box
            change = change.select("cell", "cnt", *[F.lit(None).cast(t).alias(c) for c, t in old.cells.dtypes if c not in ("cell", "cnt")])
        corners = [c for c in old.cells.columns if c not in ("cell", "cnt")]
        both = old.cells.unionByName(change).groupBy("cell").agg(F.sum("cnt").alias("cnt"), *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in corners])
        cells = settled(both.where("cnt > 0"), "updates-cells")  # 2**LEVELS rows at most
        return SpatialTable(points, self.dim, CellTable(points, self.dim, split=old.split, cells=cells))

    def insert(self, more: DataFrame) -> SpatialTable:
        return self._with(insert(self.points, more), more, 1)

    def delete(self, gone: DataFrame, strict: bool = True) -> SpatialTable:
        """A lenient delete first looks up which rows are there."""
        if strict:
            return self._with(delete_strict(self.points, gone), gone, -1)
        columns = self.points.columns
        absent = unmatched(self.points, gone)
        there = settled(gone.select(*columns).exceptAll(absent), "updates-there")
        return self._with(delete_lenient(self.points, there), there, -1)

    def clear(self) -> SpatialTable:
        return SpatialTable(self.points.limit(0), self.dim)

    def rebalanced(self, ratio: int = 30) -> SpatialTable:
        """New splits if some node's halves differ by more than the ratio allows."""
        if self.layout.imbalance(ratio).where("unbalanced").isEmpty():
            return self
        return SpatialTable(self.points, self.dim)

    def root(self) -> DataFrame:
        return self.layout.root()

    def validate(self) -> DataFrame:
        """Cells whose rows lie outside their recorded boxes or differ from their recorded counts."""
        return self.layout.violations()

    def knn(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        return self.layout.knn(queries, k, exclude_self)

    def count_in_boxes(self, boxes: DataFrame) -> DataFrame:
        return self.layout.count_in_boxes(boxes)

    def count_in_balls(self, balls: DataFrame) -> DataFrame:
        return self.layout.count_in_balls(balls)

    def report_boxes(self, boxes: DataFrame) -> DataFrame:
        return self.layout.report_boxes(boxes)
