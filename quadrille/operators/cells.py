"""A spatial layout of cells that grows with the data, and the joins that it prunes.

The points are split at medians of a sample, level by level, until a cell has about
``CELL_ROWS`` rows (all rows are the sample if they are few, so a small layout is exact);
``LEVELS`` bounds the tree, which every task holds with the count and box of each node.
Beyond that cells get larger, and are dealt to several tasks.

* The widest dimension is split; where the widths of the regions are known (``rule``), the widest in
  units of these, so that few cells are cut and read for few points.
* A region goes down the tree: a node that lies in it adds its count unread, at any level;
  only the cells that it cuts are read.
* A search reads its own cell first. The k-th distance there bounds it, and only the cells
  nearer than that are read then.

A region or query is sent to the cells that it needs, and each cell meets its own in one
task, which cuts the cell into buckets and compares those that can matter. Cells of many
rows, or that many regions need, are dealt to a grid of tasks, so no key is too hot.

Rows with a null coordinate are in no region and are no neighbour. Coordinates are whole
numbers or doubles; a squared distance beyond 64 bits is an error.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.geometry import coords, imbalanced, point_in_box
from quadrille.operators.celltree import REGIONS, Balls, Boxes, Buckets, OpenBoxes, Split, Tree, min_dist2, split_sample, weight_in_boxes
from quadrille.operators.knn import top_k
from quadrille.sources.shared import settled

SAMPLE = 20_000
SAMPLED_CELL = 8
CELL_ROWS = 4_096
LEVELS = 16
EXPRESSED = 64
PART_ROWS, PACK_ROWS = 65_536, 65_536
WIDE_ROWS, HELD_PARTS = 131_072, 2
PAIRS_EACH, PAIRS_LEAST, KEYS_CORE, MOST_TASKS = 1 << 32, 1 << 24, 4, 2_048
ROUTED_REGIONS, ROUTED_ROWS = 512, 16_384

__all__ = ["CellTable", "Split", "cell_column", "split_sample"]


def leaves(split: Split) -> int:
    return 1 if split.left is None else leaves(split.left) + leaves(split.right)


def cell_column(split: Split, cell: int = 1, prefix: str = "c") -> Column:
    """The leaf's number, the path of turns after a leading one, as an expression."""
    if split.left is None:
        return F.lit(cell).cast("long")
    return F.when(F.col(f"{prefix}{split.dim}") < split.at, cell_column(split.left, 2 * cell, prefix)).otherwise(cell_column(split.right, 2 * cell + 1, prefix))


def _array(batch, names: list[str], kind: str) -> np.ndarray:
    columns = [batch.column(n) for n in names]
    return np.stack([(c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)).astype(kind) for c in columns], axis=1) if columns else np.zeros((len(batch), 0))


def _names(dim: int, *prefixes: str) -> list[str]:
    return [f"{p}{i}" for p in prefixes for i in range(dim)]


class CellTable:
    """Points with their cells, and the cells' counts and boxes."""

    def __init__(self, points: DataFrame, dim: int, levels: int | None = None, rule: str | tuple = "widest", split: Split | None = None, sample: int = SAMPLE, cells: DataFrame | None = None, cell_rows: int = CELL_ROWS):
        self.dim = dim
        kinds = {dict(points.dtypes)[c] for c in _names(dim, "c")}
        self.kind = "int64" if kinds <= {"tinyint", "smallint", "int", "bigint"} else "float64"
        self.sql = "bigint" if self.kind == "int64" else "double"
        self.points_all = points
        if split is None:
            n = points.count()
            if levels is None:
                levels = min(LEVELS, max(0, math.ceil(math.log2(max(1, n) / cell_rows))))
            sample = max(sample, SAMPLED_CELL << levels) if n > sample else n
            drawn = points.select(*[F.col(c).cast(self.sql) for c in _names(dim, "c")]).dropna()
            if n > sample:
                drawn = drawn.orderBy(F.xxhash64(*coords(dim)), *coords(dim)).limit(sample)
            split = split_sample(_array(drawn.toArrow(), _names(dim, "c"), self.kind), dim, levels, rule)
        self.split = split
        if "cell" in points.columns:
            self.points = points
        elif leaves(split) <= EXPRESSED:
            self.points = points.withColumn("cell", cell_column(split))
        else:
            self.points = points.withColumn("cell", self._cell_udf()(*coords(dim)))
        self.cells = cells if cells is not None else self._counted(self.points)
        self._tree = None

    def _cell_udf(self):
        empty, kind, dim = Tree(self.split, self.dim, {}, self.kind), self.kind, self.dim
        sent = SparkSession.active().sparkContext.broadcast(empty)

        @F.arrow_udf("long")
        def cell(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) for c in columns], axis=1).reshape(-1, dim)
            return pa.array(sent.value.cell_of(x))

        return cell

    def _counted(self, points: DataFrame) -> DataFrame:
        """(cell, cnt, lo .., hi ..) of rows with a cell."""
        return points.groupBy("cell").agg(F.count(F.lit(1)).alias("cnt"), *[F.min(f"c{i}").alias(f"lo{i}") for i in range(self.dim)], *[F.max(f"c{i}").alias(f"hi{i}") for i in range(self.dim)])

    def tree(self) -> Tree:
        """The nodes with counts and boxes; at most 2**LEVELS cells reach the driver."""
        if self._tree is None:
            held = {r.cell: (r.cnt, [r[f"lo{i}"] for i in range(self.dim)], [r[f"hi{i}"] for i in range(self.dim)]) for r in self.cells.where("cnt > 0").dropna().collect()}
            self._tree = Tree(self.split, self.dim, held, self.kind)
        return self._tree

    # ---- layout

    def clustered(self, partitions: int | None = None) -> DataFrame:
        """Rows of a cell together and sorted, ready to be written: readers then skip by min and max."""
        dealt = self.points.repartitionByRange(partitions, "cell") if partitions else self.points.repartitionByRange("cell")
        return dealt.sortWithinPartitions("cell", *coords(self.dim))

    def write(self, path: str) -> None:
        """Points in the order of cells, the cells, and the splits."""
        spark = self.points.sparkSession
        self.clustered().write.parquet(f"{path}/points")
        self.cells.coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(bytearray(pickle.dumps(self.split)), self.dim)], "split binary, dim int").coalesce(1).write.parquet(f"{path}/splits")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CellTable:
        """A written layout, without a look at its points."""
        kept = spark.read.parquet(f"{path}/splits").first()
        return cls(spark.read.parquet(f"{path}/points"), kept.dim, split=pickle.loads(bytes(kept.split)), cells=spark.read.parquet(f"{path}/cells"))

    def root(self) -> DataFrame:
        """(cnt, lo .., hi ..): the box of the whole layout, from the cells alone."""
        return self.cells.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("cnt"), *[F.min(c).alias(c) for c in _names(self.dim, "lo")], *[F.max(c).alias(c) for c in _names(self.dim, "hi")])

    def depth_stats(self) -> DataFrame:
        """Greatest and mean depth of the cells; the root's is 0."""
        depth = F.floor(F.log2(F.col("cell")))
        return self.cells.agg(F.max(depth).cast("long").alias("max_depth"), F.avg(depth).alias("mean_depth"), F.count(F.lit(1)).alias("cells"))

    def leaf_histogram(self) -> DataFrame:
        """(depth, cnt, cells): how many cells have a depth and a number of rows."""
        return self.cells.groupBy(F.floor(F.log2(F.col("cell"))).cast("long").alias("depth"), "cnt").agg(F.count(F.lit(1)).alias("cells"))

    def rolled_up(self) -> DataFrame:
        """Counts of all nodes above the cells, by their paths."""
        up = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("cell"))).cast("int")), lambda h: F.call_function("shiftright", F.col("cell"), h))
        return self.cells.select(F.explode(up).alias("node"), "cnt").groupBy("node").agg(F.sum("cnt").alias("cnt"))

    def imbalance(self, ratio: int = 30) -> DataFrame:
        """Inner nodes whose halves differ too much: candidates for a new split."""
        nodes = self.rolled_up()
        left = nodes.select((F.col("node") / 2).cast("long").alias("node"), F.col("cnt").alias("left_cnt"), (F.col("node") % 2).alias("side")).where("side = 0 AND node > 0")
        leaf = self.cells.select(F.col("cell").alias("node"))
        inner = nodes.join(F.broadcast(leaf), "node", "left_anti").join(F.broadcast(left), "node", "left")
        return inner.select("node", "cnt", F.coalesce("left_cnt", F.lit(0).cast("long")).alias("left_cnt")).withColumn("unbalanced", imbalanced(F.col("left_cnt"), F.col("cnt"), ratio))

    def thin(self, least: int = 24) -> DataFrame:
        """(cell, merged, cnt): a cell of fewer rows goes to its parent, to be written with what else is there."""
        merged = F.when((F.col("cnt") < least) & (F.col("cell") > 1), F.shiftright("cell", 1)).otherwise(F.col("cell"))
        return self.cells.select("cell", merged.alias("merged"), "cnt")

    def violations(self) -> DataFrame:
        """Cells whose rows lie outside their boxes or whose counts are off, by the cells on record; no rows if all is well."""
        found = self.points.join(F.broadcast(self.cells), "cell", "left")
        inside = point_in_box(coords(self.dim), coords(self.dim, "lo"), coords(self.dim, "hi"))
        seen = found.groupBy("cell").agg(F.count(F.lit(1)).alias("seen"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"))
        both = seen.join(self.cells.select("cell", "cnt"), "cell", "full").select("cell", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("outside", F.lit(0)).alias("outside"), F.coalesce("cnt", F.lit(0)).alias("cnt"))
        return both.where((F.col("outside") > 0) | (F.col("seen") != F.col("cnt")))

    def rotation_violations(self) -> DataFrame:
        """(cell, dim, expected): inner nodes that don't cut the dimension whose turn it is."""
        rows, open_ = [], [(self.split, 1, 0)]
        while open_:
            s, number, level = open_.pop()
            if s.left is not None:
                if s.dim != level % self.dim:
                    rows.append((number, s.dim, level % self.dim))
                open_ += [(s.left, 2 * number, level + 1), (s.right, 2 * number + 1, level + 1)]
        return self.points.sparkSession.createDataFrame(rows, "cell long, dim int, expected int")

    # ---- what meets in a cell

    def _placed(self, columns: list[str]) -> DataFrame:
        return self.points.select("cell", *columns, *[F.col(c).cast(self.sql).alias(c) for c in _names(self.dim, "c")]).dropna(subset=_names(self.dim, "c"))

    def _met(self, routed: DataFrame, points: DataFrame, run, schema: str) -> DataFrame:
        """``run(routed rows, points)`` for each cell of ``routed`` (cell ..), as tables.

        The cells' sizes and how often each is asked for are known (2**LEVELS numbers at
        most): beyond ``PART_ROWS`` or ``PACK_ROWS`` a cell is dealt to a grid of tasks.
        Only cells that are asked for are read.
        """
        spark, sizes = routed.sparkSession, {int(n): int(c) for n, c, low in zip(self.tree().number, self.tree().count, self.tree().left) if low < 0 and c}
        asked = {r.cell: r.n for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(asked) < len(sizes):
            if len(asked) <= EXPRESSED:
                points = points.where(F.col("cell").isin(sorted(asked)))
            else:
                points = points.join(F.broadcast(spark.createDataFrame([(c,) for c in asked], "cell long")), "cell", "left_semi")
        hot = [(c, -(-sizes.get(c, 0) // PART_ROWS) or 1, -(-n // PACK_ROWS)) for c, n in asked.items() if n > PACK_ROWS or sizes.get(c, 0) > PART_ROWS]
        keys = ["cell"]
        if hot:
            keys = ["cell", "part", "pack"]
            grid = F.broadcast(spark.createDataFrame(hot, "cell long, parts int, packs int"))
            each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
            deal = lambda frame, n: F.pmod(F.xxhash64(*[c for c in frame.columns if c != "cell"]), F.coalesce(n, F.lit(1))).cast("int")
            points = points.join(grid, "cell", "left").withColumn("part", deal(points, F.col("parts"))).withColumn("pack", each(F.col("packs"))).drop("parts", "packs")
            routed = routed.join(grid, "cell", "left").withColumn("pack", deal(routed, F.col("packs"))).withColumn("part", each(F.col("parts"))).drop("parts", "packs")
        return routed.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInArrow(run, schema)

    # ---- ranges

    def _regions(self, frame: DataFrame, ball: bool) -> tuple[DataFrame, list[str]]:
        names = [*_names(self.dim, "q"), "r"] if ball else _names(self.dim, "lo", "hi")
        kind = "double" if self.sql == "double" or {dict(frame.dtypes)[n] for n in names} & {"double", "float"} else "bigint"
        return frame.select("qid", *[F.col(n).cast(kind).alias(n) for n in names]).dropna(subset=names), names

    def _routed(self, regions: DataFrame, names: list[str], ball: bool) -> DataFrame:
        """A row for each region with the count of nodes inside it (cell null), and one for each cell that it cuts."""
        sent, made = regions.sparkSession.sparkContext.broadcast(self.tree()), _maker(self.dim, names, ball)
        schema = ", ".join([*[f"{n} {t}" for n, t in regions.dtypes], "cell long", "whole long", "nodes long"])

        def run(batches):
            tree: Tree = sent.value
            for batch in batches:
                for at in range(0, len(batch), REGIONS):
                    part = batch.slice(at, REGIONS)
                    shapes = made(part)
                    in_r, in_n, cut_r, cut_n = tree.touched(len(part), lambda r, n: shapes.meets(r, tree.lo[n], tree.hi[n]), lambda r, n: shapes.inside(r, tree.lo[n], tree.hi[n]))
                    whole, nodes = np.zeros(len(part), np.int64), np.bincount(in_r, minlength=len(part))
                    np.add.at(whole, in_r, tree.count[in_n])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(len(part), pa.int64()), pa.array(whole), pa.array(nodes)], names=[*part.schema.names, "cell", "whole", "nodes"])
                    if len(cut_r):
                        cut = part.take(pa.array(cut_r))
                        yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(tree.number[cut_n]), pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.int64())], names=[*part.schema.names, "cell", "whole", "nodes"])

        return regions.mapInArrow(run, schema)

    def _count(self, frame: DataFrame, ball: bool) -> DataFrame:
        """Equal regions are one, and equal points are one with a weight."""
        regions, names = self._regions(frame, ball)
        routed, made, kinds = self._routed(regions.select(*names).distinct(), names, ball), _maker(self.dim, names, ball), dict(regions.dtypes)
        own, dim, numbers = _names(self.dim, "c"), self.dim, self.kind

        def run(asked: pa.Table, points: pa.Table) -> pa.Table:
            found = np.zeros(len(asked), np.int64)
            if len(points) and len(asked):
                x, weight = _array(points, own, numbers).reshape(-1, dim), points["weight"].to_numpy()
                found = Buckets(x).counts(made(asked), weight) if ball else weight_in_boxes(x, weight, made(asked))
            return pa.table({**{n: asked[n] for n in names}, "cnt": pa.array(found)})

        points = self._placed([]).groupBy("cell", *own).agg(F.count(F.lit(1)).alias("weight"))
        some = self._met(routed.where("cell IS NOT NULL").select("cell", *names), points, run, ", ".join([*[f"{n} {kinds[n]}" for n in names], "cnt long"]))
        whole = routed.where("cell IS NULL").select(*names, F.col("whole").alias("cnt"))
        counted = whole.unionAll(some).groupBy(*names).agg(F.sum("cnt").alias("cnt"))
        none = frame.select("qid", F.lit(0).cast("long").alias("cnt"))
        return none.unionAll(regions.join(counted, names).select("qid", "cnt")).groupBy("qid").agg(F.sum("cnt").alias("cnt"))

    def _report(self, frame: DataFrame, ball: bool, open_: bool = False) -> DataFrame:
        """A region is sent to the cells that it meets. A task holds the points of one cell, its regions pass by, and what they find goes on in small parts."""
        regions, names = self._regions(frame, ball)
        made, kinds = _maker(self.dim, names, ball, open_), dict(self.points.dtypes)
        sent = regions.sparkSession.sparkContext.broadcast(self.tree())
        own, dim, numbers = _names(self.dim, "c"), self.dim, self.kind

        def route(batches):
            tree: Tree = sent.value
            for batch in batches:
                for at in range(0, len(batch), ROUTED_REGIONS):
                    part = batch.slice(at, ROUTED_REGIONS)
                    shapes = made(part)
                    _, _, r, n = tree.touched(len(part), lambda r, n: shapes.meets(r, tree.lo[n], tree.hi[n]), None)
                    for k in range(0, len(r), ROUTED_ROWS):  # a region meets many cells: neither side holds all of them
                        yield pa.RecordBatch.from_arrays([pa.array(tree.number[n[k : k + ROUTED_ROWS]]), *part.take(pa.array(r[k : k + ROUTED_ROWS])).columns], names=["cell", *part.schema.names])

        def search(batches):
            at, near = None, []
            for batch in batches:
                key, asks = batch.column("key").to_numpy(), batch.column("asks").to_numpy()
                turns = np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1
                for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(batch)]):
                    if b > a and key[a] != at:
                        at, near, buckets = key[a], [], None
                    part = batch.slice(a, b - a)
                    if b > a and not asks[a]:
                        near.append(part.select(["id", *own]))
                    elif b > a and near:
                        asked = made(part)
                        if buckets is None:
                            near = pa.Table.from_batches(near).combine_chunks()
                            buckets = Buckets(_array(near, own, numbers), asked.widths())
                            held = near.take(pa.array(buckets.order)).to_batches()[0]
                        for r, place in buckets.reports(asked):
                            yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(r)), *held.take(pa.array(place)).columns], names=["qid", "id", *own])

        routed = regions.mapInArrow(route, ", ".join(["cell long", *[f"{n} {t}" for n, t in regions.dtypes]]))
        routed, points, tasks = self._dealt(routed, self._placed(["id"]))
        empty = lambda frame: [F.lit(None).cast(t).alias(n) for n, t in frame.dtypes if n != "key"]
        both = points.select("key", F.lit(0).alias("asks"), *[c for c in points.columns if c != "key"], *empty(routed)).unionAll(routed.select("key", F.lit(1).alias("asks"), *empty(points), *[c for c in routed.columns if c != "key"]))
        met = both.repartitionById(tasks, "key").sortWithinPartitions("key", "asks", *own, "id", *names, "qid")
        found = met.mapInArrow(search, ", ".join([f"qid {dict(regions.dtypes)['qid']}", f"id {kinds['id']}", *[f"{c} {self.sql}" for c in own]]))
        return found.select("qid", "id", *[F.col(c).cast(kinds[c]).alias(c) for c in own])

    def _dealt(self, routed: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Both sides with a key in place of the cell, dealt so that a key has at most ``HELD_PARTS * PART_ROWS`` points and ``PAIRS_EACH`` pairs, and the number of tasks.

        Fewer pairs, down to ``PAIRS_LEAST``, if there would be few keys for the cores.
        """
        spark, sizes = routed.sparkSession, {int(n): int(c) for n, c, low in zip(self.tree().number, self.tree().count, self.tree().left) if low < 0 and c}
        asked = [(r.cell, r.n, sizes[r.cell]) for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect() if r.cell in sizes]
        pairs = sum(n * size for _, n, size in asked)
        each = min(PAIRS_EACH, max(PAIRS_LEAST, pairs // (KEYS_CORE * spark.sparkContext.defaultParallelism)))
        grid, keys = [], 0
        for cell, n, size in sorted(asked):
            parts = -(-size // (HELD_PARTS * PART_ROWS))
            packs = -(-n * -(-size // parts) // each)
            grid.append((cell, keys, parts, packs))
            keys += parts * packs
        if len(grid) < len(sizes) and len(grid) <= EXPRESSED:
            points = points.where(F.col("cell").isin([c for c, *_ in grid]))
        grid = F.broadcast(spark.createDataFrame(grid, "cell long, first int, parts int, packs int"))
        each_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        deal = lambda frame, n: F.pmod(F.xxhash64(*[c for c in frame.columns if c != "cell"]), n).cast("int")
        key = (F.col("first") + F.col("part") * F.col("packs") + F.col("pack")).alias("key")
        points, routed = (frame.join(grid, "cell").withColumn(mine, deal(frame, F.col(f"{mine}s"))).withColumn(other, each_of(F.col(f"{other}s"))).select(key, *[c for c in frame.columns if c != "cell"]) for frame, mine, other in ((points, "part", "pack"), (routed, "pack", "part")))
        return routed, points, max(1, min(keys, MOST_TASKS))

    def count_in_boxes(self, boxes: DataFrame) -> DataFrame:
        """(qid, cnt), zero counts included; closed boxes."""
        return self._count(boxes, False)

    def count_in_balls(self, balls: DataFrame) -> DataFrame:
        return self._count(balls, True)

    def report_boxes(self, boxes: DataFrame, open_: bool = False) -> DataFrame:
        """(qid, id, c0 ..): every point of every box; with ``open_`` without its sides."""
        return self._report(boxes, False, open_)

    def report_balls(self, balls: DataFrame) -> DataFrame:
        return self._report(balls, True)

    def visited_boxes(self, boxes: DataFrame) -> DataFrame:
        """(qid, nodes, cells): nodes that a box takes whole, and cells that it reads."""
        routed = self._routed(*self._regions(boxes, False), False)
        return routed.groupBy("qid").agg(F.sum("nodes").alias("nodes"), F.count("cell").alias("cells"))

    # ---- neighbours

    def _near(self, queries: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame, str]:
        """Neighbours in each query's own cell, and in the other cells that are near enough."""
        kinds, dim, numbers = dict(queries.dtypes), self.dim, self.kind
        kind = "float64" if numbers == "float64" or {kinds[c] for c in _names(dim, "q")} & {"double", "float"} else "int64"
        sql, asks, own = "bigint" if kind == "int64" else "double", _names(dim, "q"), _names(dim, "c")
        asking = queries.select("qid", *[F.col(c).cast(sql).alias(c) for c in asks]).dropna()
        sent, ids = asking.sparkSession.sparkContext.broadcast(self.tree()), dict(self.points.dtypes)["id"]
        arrow = pa.int64() if kind == "int64" else pa.float64()

        def home(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.cell_of(_array(batch, asks, kind))), *batch.columns], names=["cell", *batch.schema.names])

        def search(asked: pa.Table, points: pa.Table):
            q, qid = _array(asked, asks, kind), asked["qid"].to_numpy()
            x = _array(points, own, kind).reshape(-1, dim)
            bound = None
            if "bound" in asked.schema.names:
                bound = asked["bound"].to_numpy()
                none = np.array(asked["bound"].is_null().to_pylist(), dtype=bool)
                bound = np.where(none, np.iinfo(np.int64).max if kind == "int64" else np.inf, np.nan_to_num(bound.astype(float))) if none.any() and kind == "float64" else bound
                if none.any() and kind == "int64":
                    bound = np.array([np.iinfo(np.int64).max if v is None else v for v in asked["bound"].to_pylist()], dtype=np.int64)
            found = list(Buckets(x).nearest(points["id"].to_numpy(), q, qid if exclude_self else None, k, bound)) if len(points) and len(q) else []
            return [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)]

        def first(asked: pa.Table, points: pa.Table) -> pa.Table:
            row, place, value = search(asked, points)
            order = np.argsort(row, kind="stable")
            row, place, value = row[order], place[order], value[order]
            upto = np.searchsorted(row, np.arange(len(asked) + 1)).astype(np.int32)
            last = [value[b - 1].item() if b - a == k else None for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
            near = pa.ListArray.from_arrays(pa.array(upto), points["id"].combine_chunks().take(pa.array(place)) if len(points) else pa.array([], points.schema.field("id").type))
            return pa.table({"qid": asked["qid"], **{c: asked[c] for c in asks}, "cell": asked["cell"], "bound": pa.array(last, arrow), "nid": near, "dist2": pa.ListArray.from_arrays(pa.array(upto), pa.array(value.astype(kind)))})

        def others(batches):
            tree: Tree = sent.value
            for batch in batches:
                for at in range(0, len(batch), REGIONS):
                    part = batch.slice(at, REGIONS)
                    q, bound = _array(part, asks, kind), part.column("bound")
                    most = np.array([math.inf if v is None else v for v in bound.to_pylist()], dtype=object if kind == "int64" else float)
                    free = np.array([v is None for v in bound.to_pylist()], dtype=bool)
                    held = np.where(free, 0, most).astype(kind)
                    _, _, r, n = tree.touched(len(part), lambda r, n: free[r] | (min_dist2(q[r], tree.lo[n].astype(kind), tree.hi[n].astype(kind)) <= held[r]), None)
                    away = tree.number[n] != part.column("cell").to_numpy()[r]
                    r, n = r[away], n[away]
                    yield pa.RecordBatch.from_arrays([pa.array(tree.number[n]), *part.take(pa.array(r)).select(["qid", *asks, "bound"]).columns], names=["cell", "qid", *asks, "bound"])

        def second(asked: pa.Table, points: pa.Table) -> pa.Table:
            row, place, value = search(asked, points)
            near = points["id"].combine_chunks().take(pa.array(place)) if len(points) else pa.array([], points.schema.field("id").type)
            return pa.table({"qid": asked["qid"].take(pa.array(row)), "nid": near, "dist2": pa.array(value.astype(kind))})

        shape = ", ".join([f"qid {kinds['qid']}", *[f"{c} {sql}" for c in asks]])
        at_home = self._met(asking.mapInArrow(home, f"cell long, {shape}"), self._placed(["id"]), first, f"{shape}, cell long, bound {sql}, nid array<{ids}>, dist2 array<{sql}>")
        if max(self.tree().count, default=0) > 0 and max((c for c, low in zip(self.tree().count, self.tree().left) if low < 0), default=0) > PART_ROWS:
            # a cell that was dealt answers in parts: the least of their bounds holds
            at_home = at_home.groupBy("qid", *asks, "cell").agg(F.min("bound").alias("bound"), F.flatten(F.collect_list("nid")).alias("nid"), F.flatten(F.collect_list("dist2")).alias("dist2"))
        at_home = settled(at_home, "cells-home")
        routed = at_home.select("qid", *asks, "cell", "bound").mapInArrow(others, f"cell long, {shape}, bound {sql}")
        return at_home, routed, (second, f"qid {kinds['qid']}, nid {ids}, dist2 {sql}")

    def knn(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """(qid, nid, dist2, rk), equal to the full comparison."""
        home, routed, (run, schema) = self._near(queries, k, exclude_self)
        mine = home.select("qid", F.explode(F.arrays_zip("nid", "dist2")).alias("n")).select("qid", "n.nid", "n.dist2")
        return top_k(mine.unionAll(self._met(routed, self._placed(["id"]), run, schema)), k)

    def visited(self, queries: DataFrame, k: int) -> DataFrame:
        """Mean number of cells that a query reads, its own with them."""
        home, routed, _ = self._near(queries, k, False)
        cells = home.select("qid").unionAll(routed.select("qid"))
        return cells.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_cells"))


def _maker(dim: int, names: list[str], ball: bool, open_: bool = False):
    """Regions of a table's rows."""

    def made(rows):
        kind = "float64" if any(pa.types.is_floating(rows.schema.field(n).type) for n in names) else "int64"
        if ball:
            return Balls(_array(rows, names[:dim], kind), _array(rows, names[dim:], kind)[:, 0])
        return (OpenBoxes if open_ else Boxes)(_array(rows, names[:dim], kind), _array(rows, names[dim:], kind))

    return made
