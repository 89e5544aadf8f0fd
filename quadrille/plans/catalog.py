"""The registered queries over the spatial operators, with their SQL oracles.

A query without an oracle is beyond SQL (seeded generators) and is tested in ``tests``
instead. Neighbour searches ask with the rows whose id is divisible by
100, one percent, as the published workload does; self joins ask with all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geometry as G
from quadrille.operators import aggregates, graphs, knn, logs, replay, updates, workloads, zorder
from quadrille.operators.cells import WIDE_ROWS, CellTable, Split
from quadrille.plans import views as V
from quadrille.sources import generators, text
from quadrille.sources.shared import shared_dir

_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f: Callable) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = V.with_views(sql, *views) if views else sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


# ---------------------------------------------------------------- scans


@query("SELECT id, c0, c1 FROM pts", "pts")
def scan_points(spark, sf):
    return V.parts(spark, sf)


@query("SELECT c0, c1 FROM lines", "lines")
def project_dims(spark, sf):
    return V.lines(spark, sf).select("c0", "c1")


@query("SELECT c0, c2 AS c1, count(*) AS mult FROM lines GROUP BY ALL", "lines")
def multiplicity(spark, sf):
    return aggregates.multiplicities(V.lines(spark, sf).select("c0", F.col("c2").alias("c1")), 2)


@query("SELECT c0, c2 AS c1 FROM lines", "lines")
def flatten_multiplicity(spark, sf):
    return aggregates.expanded(multiplicity(spark, sf))


@query("SELECT id, c0, c1 FROM pts", "pts")
def text_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}/1.in"
    points = V.parts(spark, sf)
    text.write_points(points, path, 2)
    return text.read_points(spark, path, "bigint")


@query()
def uniform_gen(spark, sf):
    return generators.uniform(spark, 10_000, 3)


@query()
def clustered_gen(spark, sf):
    return generators.clustered(spark, 10_000, 2)


# ---------------------------------------------------------------- aggregates


@query("SELECT min(c0) AS lo0, min(c1) AS lo1, max(c0) AS hi0, max(c1) AS hi1 FROM pts", "pts")
def bbox(spark, sf):
    return aggregates.bounding_box(V.parts(spark, sf), 2)


@query("SELECT min(c0) AS lo0, min(c1) AS lo1, max(c0) AS hi0, max(c1) AS hi1 FROM (SELECT c0, c1 FROM pts UNION ALL SELECT c0, c1 FROM cust)", "pts", "cust")
def bbox_merge(spark, sf):
    a = aggregates.bounding_box(V.parts(spark, sf), 2)
    b = aggregates.bounding_box(V.customers(spark, sf), 2).select(*[F.col(f"{s}{i}").alias(f"o{s}{i}") for s in ("lo", "hi") for i in range(2)])
    lo, hi = G.merged_box(G.coords(2, "lo"), G.coords(2, "hi"), G.coords(2, "olo"), G.coords(2, "ohi"))
    return a.join(b).select(*[x.alias(f"lo{i}") for i, x in enumerate(lo)], *[x.alias(f"hi{i}") for i, x in enumerate(hi)])


@query("SELECT count(*) AS cnt FROM lines", "lines")
def size(spark, sf):
    return aggregates.size(V.lines(spark, sf))


@query("SELECT count(*) AS cnt FROM (SELECT DISTINCT c0, c1, c2 FROM lines)", "lines")
def distinct_size(spark, sf):
    return aggregates.distinct_size(V.lines(spark, sf), 3)


@query("SELECT CAST(CASE WHEN max(c0) - min(c0) >= max(c1) - min(c1) THEN 0 ELSE 1 END AS BIGINT) AS dim FROM pts", "pts")
def widest_dim(spark, sf):
    return aggregates.widest(V.parts(spark, sf), 2)


@query("SELECT count(*) <= 1 AS same FROM (SELECT DISTINCT c0, c1 FROM pts)", "pts")
def all_identical(spark, sf):
    return aggregates.all_identical(V.parts(spark, sf), 2)


@query("SELECT c1 AS median FROM (SELECT c1, row_number() OVER (ORDER BY c1) AS r, count(*) OVER () AS n FROM lines) WHERE r = n // 2 + 1", "lines")
def median_upper(spark, sf):
    return aggregates.upper_median(V.lines(spark, sf), "c1")


# ---------------------------------------------------------------- predicates and distances

_BOX = ([10, 90_000], [30, 99_000])
_BALL = ([25, 95_000], 4_500)
_LOW_BALL = ([25, 88_000], 4_500)


def _literals(values):
    return [F.lit(v).cast("long") for v in values]


@query("SELECT id, c0, c1 FROM pts WHERE c0 BETWEEN 10 AND 30 AND c1 BETWEEN 90000 AND 99000", "pts")
def point_in_box(spark, sf):
    return V.parts(spark, sf).where(G.point_in_box(G.coords(2), *map(_literals, _BOX)))


@query("SELECT id, c0, c1 FROM pts WHERE (c0 - 25) * (c0 - 25) + (c1 - 95000) * (c1 - 95000) <= 4500::BIGINT * 4500", "pts")
def point_in_ball(spark, sf):
    return V.parts(spark, sf).where(G.point_in_ball(G.coords(2), _literals(_BALL[0]), *_literals(_BALL[1:])))


def _own_boxes(spark, sf):
    p = V.parts(spark, sf)
    return p.select("id", (F.col("c0") - 3).alias("lo0"), (F.col("c1") - 4000).alias("lo1"), (F.col("c0") + 3).alias("hi0"), (F.col("c1") + 4000).alias("hi1"))


_OWN = "+own AS (SELECT id, c0 - 3 AS lo0, c1 - 4000 AS lo1, c0 + 3 AS hi0, c1 + 4000 AS hi1 FROM pts) "


def _box_tests(spark, sf):
    lo, hi = G.coords(2, "lo"), G.coords(2, "hi")
    return _own_boxes(spark, sf), lo, hi


@query(_OWN + "SELECT id FROM own WHERE lo0 >= 10 AND hi0 <= 30 AND lo1 >= 90000 AND hi1 <= 99000", "pts")
def box_in_box(spark, sf):
    b, lo, hi = _box_tests(spark, sf)
    return b.where(G.box_in_box(lo, hi, *map(_literals, _BOX))).select("id")


@query(_OWN + "SELECT id FROM own WHERE lo0 <= 30 AND hi0 >= 10 AND lo1 <= 99000 AND hi1 >= 90000", "pts")
def box_intersects_box(spark, sf):
    b, lo, hi = _box_tests(spark, sf)
    return b.where(G.box_meets_box(lo, hi, *map(_literals, _BOX))).select("id")


#: Every third box has its low corner above the high one.
@query("SELECT id FROM (SELECT id, c0 - 3 AS lo0, c0 + 3 - (id % 3) * 4 AS hi0 FROM pts) WHERE lo0 <= hi0", "pts")
def legal_box(spark, sf):
    b, lo, hi = _box_tests(spark, sf)
    b = b.withColumn("hi0", F.col("hi0") - F.col("id") % 3 * 4)
    return b.where(G.legal_box(lo, hi)).select("id")


@query("SELECT id FROM pts WHERE c0 > 9.5 AND c0 < 30.5 AND c1 > 89999.5 AND c1 < 99000.5", "pts")
def point_in_widened_box(spark, sf):
    return V.parts(spark, sf).where(G.point_in_widened_box(G.coords(2), *map(_literals, _BOX), 0.5)).select("id")


@query("SELECT id FROM pts WHERE c0 - c0 % 5 = c0 AND c1 - c1 % 10 = c1", "pts")
def same_point(spark, sf):
    rounded = [F.col("c0") - F.col("c0") % 5, F.col("c1") - F.col("c1") % 10]
    return V.parts(spark, sf).where(G.same_point(G.coords(2), rounded)).select("id")


@query(_OWN + "SELECT id FROM own WHERE hi0 = lo0 + id % 4 * 2", "pts")
def same_box(spark, sf):
    b, lo, hi = _box_tests(spark, sf)
    return b.where(G.same_box(lo, hi, lo, [lo[0] + F.col("id") % 4 * 2, hi[1]])).select("id")


_FAR = "greatest(abs(25 - lo0), abs(hi0 - 25)) ** 2 + greatest(abs(95000 - lo1), abs(hi1 - 95000)) ** 2"
_NEAR = "greatest(lo0 - 25, 25 - hi0, 0) ** 2 + greatest(lo1 - 88000, 88000 - hi1, 0) ** 2"


@query(_OWN + f"SELECT id FROM own WHERE {_FAR} <= 4500.0 ** 2", "pts")
def box_in_ball(spark, sf):
    b, lo, hi = _box_tests(spark, sf)
    return b.where(G.box_in_ball(lo, hi, _literals(_BALL[0]), *_literals(_BALL[1:]))).select("id")


@query(_OWN + f"SELECT id FROM own WHERE {_NEAR} <= 4500.0 ** 2", "pts")
def ball_intersects_box(spark, sf):
    b, lo, hi = _box_tests(spark, sf)
    return b.where(G.ball_meets_box(lo, hi, _literals(_LOW_BALL[0]), *_literals(_LOW_BALL[1:]))).select("id")


@query("SELECT id, (c0 - 25) * (c0 - 25) + (c1 - 95000) * (c1 - 95000) AS dist2 FROM pts", "pts")
def dist2(spark, sf):
    return V.parts(spark, sf).select("id", G.dist2(G.coords(2), _literals(_BALL[0])).alias("dist2"))


@query(_OWN + f"SELECT id, CAST({_NEAR} AS BIGINT) AS d FROM own", "pts")
def min_dist_box(spark, sf):
    b, lo, hi = _box_tests(spark, sf)
    return b.select("id", G.min_dist2(_literals(_LOW_BALL[0]), lo, hi).alias("d"))


@query(_OWN + f"SELECT id, CAST({_FAR} AS BIGINT) AS d FROM own", "pts")
def max_dist_box(spark, sf):
    b, lo, hi = _box_tests(spark, sf)
    return b.select("id", G.max_dist2(_literals(_BALL[0]), lo, hi).alias("d"))


# ---------------------------------------------------------------- neighbours


def _asking(points: DataFrame, dim: int = 2) -> DataFrame:
    return workloads.as_queries(points.where("id % 100 = 0"), dim)


_PAIRS = "SELECT q.id AS qid, p.id AS nid, (p.c0 - q.c0) * (p.c0 - q.c0) + (p.c1 - q.c1) * (p.c1 - q.c1) AS dist2"
_RANK = "row_number() OVER (PARTITION BY qid ORDER BY dist2, nid)"


def _knn_sql(k: int, pairs: str = f"{_PAIRS} FROM pts p, pts q WHERE q.id % 100 = 0", what: str = "qid, nid, dist2, rk") -> str:
    return f"SELECT {what} FROM (SELECT *, {_RANK} AS rk FROM ({pairs})) WHERE rk <= {k}"


@query(_knn_sql(10), "pts")
def knn_join(spark, sf):
    points = V.parts(spark, sf)
    return CellTable(points, 2).knn(_asking(points), 10)


@query(_knn_sql(1), "pts")
def knn_k1(spark, sf):
    points = V.parts(spark, sf)
    return CellTable(points, 2).knn(_asking(points), 1)


@query(_knn_sql(100), "pts")
def knn_k100(spark, sf):
    points = V.parts(spark, sf)
    return CellTable(points, 2).knn(_asking(points), 100)


@query(_knn_sql(10), "pts")
def knn_brute(spark, sf):
    points = V.parts(spark, sf)
    return knn.brute_knn(_asking(points), points, 10, 2)


@query(_knn_sql(5, f"{_PAIRS} FROM pts p, pts q"), "pts")
def knn_self(spark, sf):
    points = V.parts(spark, sf)
    return CellTable(points, 2).knn(workloads.as_queries(points, 2), 5)


@query(_knn_sql(5, f"{_PAIRS} FROM pts p, pts q WHERE p.id <> q.id"), "pts")
def knn_self_excl(spark, sf):
    points = V.parts(spark, sf)
    return CellTable(points, 2).knn(workloads.as_queries(points, 2), 5, exclude_self=True)


@query(f"SELECT qid, max(dist2) AS kdist2 FROM ({_knn_sql(10)}) GROUP BY qid", "pts")
def knn_kth_distance(spark, sf):
    return knn.kth_distance(knn_join(spark, sf))


@query(_knn_sql(10, f"{_PAIRS} FROM pts p, cust q"), "pts", "cust")
def knn_foreign(spark, sf):
    return CellTable(V.parts(spark, sf), 2).knn(workloads.as_queries(V.customers(spark, sf), 2), 10)


_FAR_PAIRS = "SELECT q.id AS qid, p.id AS nid, (p.c0 - q.c0 - 10 * w0) ** 2 + (p.c1 - q.c1 - 10 * w1) ** 2 AS dist2 FROM pts p, pts q, (SELECT max(c0) - min(c0) AS w0, max(c1) - min(c1) AS w1 FROM pts) WHERE q.id % 100 = 0"


@query(_knn_sql(10, _FAR_PAIRS, "qid, nid, CAST(dist2 AS BIGINT) AS dist2, rk"), "pts")
def knn_far(spark, sf):
    points = V.parts(spark, sf)
    return CellTable(points, 2).knn(workloads.shifted(_asking(points), points, 2, 10), 10)


_HIGH = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(p.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), lambda a, b: a + b)"


@query(_knn_sql(10, f"SELECT q.vec_id AS qid, p.vec_id AS nid, {_HIGH} AS dist2 FROM embeddings p, embeddings q WHERE q.vec_id % 100 = 0"))
def knn_highdim(spark, sf):
    v = V.table(spark, sf, "embeddings")
    asking = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return knn.brute_knn_arrays(asking, v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)


# ---------------------------------------------------------------- ranges


def _query_boxes(spark, sf):
    return _own_boxes(spark, sf).withColumnRenamed("id", "qid")


#: Of the boxes, to split by.
_WIDTHS = (6, 8000)


def _query_balls(spark, sf):
    return workloads.as_queries(V.parts(spark, sf), 2).withColumn("r", F.lit(3000).cast("long"))


_IN_OWN = "p.c0 BETWEEN b.lo0 AND b.hi0 AND p.c1 BETWEEN b.lo1 AND b.hi1"
_COUNT_BOXES = _OWN + f"SELECT b.id AS qid, count(p.id) AS cnt FROM own b LEFT JOIN pts p ON {_IN_OWN} GROUP BY b.id"
_IN_BALL = "(p.c0 - q.c0) * (p.c0 - q.c0) + (p.c1 - q.c1) * (p.c1 - q.c1) <= 3000 * 3000"
_COUNT_BALLS = f"SELECT q.id AS qid, count(p.id) AS cnt FROM pts q LEFT JOIN pts p ON {_IN_BALL} GROUP BY q.id"
_REPORT_BOXES = _OWN + f"SELECT b.id AS qid, p.id, p.c0, p.c1 FROM own b JOIN pts p ON {_IN_OWN}"
_MATES = "+n AS (SELECT count(*) AS n FROM pts), mates AS (SELECT a.id AS qid, a.c0 AS a0, a.c1 AS a1, b.c0 AS b0, b.c1 AS b1 FROM pts a, n, pts b WHERE b.id = (a.id + n // 2) % n) "
_LINE_BOXES = "+own AS (SELECT p_partkey AS qid, CAST(p_size AS BIGINT) - 1 AS lo0, CAST(p_size AS BIGINT) + 1 AS hi0, CAST(round(p_retailprice * 100) AS BIGINT) * 10 AS lo1, CAST(round(p_retailprice * 100) AS BIGINT) * 12 AS hi1, 2 AS lo2, 6 AS hi2 FROM part) "


@query(_COUNT_BOXES, "pts")
def range_count_box(spark, sf):
    return CellTable(V.parts(spark, sf), 2, rule="rotate").count_in_boxes(_query_boxes(spark, sf))


@query(_COUNT_BOXES, "pts")
def cell_range_count(spark, sf):
    return CellTable(V.parts(spark, sf), 2).count_in_boxes(_query_boxes(spark, sf))


@query(_COUNT_BALLS, "pts")
def range_count_ball(spark, sf):
    return CellTable(V.parts(spark, sf), 2, rule="rotate").count_in_balls(_query_balls(spark, sf))


@query(_COUNT_BALLS, "pts")
def cell_ball_count(spark, sf):
    return CellTable(V.parts(spark, sf), 2).count_in_balls(_query_balls(spark, sf))


@query(_REPORT_BOXES, "pts")
def range_report_box(spark, sf):
    return CellTable(V.parts(spark, sf), 2, rule="rotate", cell_rows=WIDE_ROWS).report_boxes(_query_boxes(spark, sf))


@query(_REPORT_BOXES, "pts")
def cell_range_report(spark, sf):
    return CellTable(V.parts(spark, sf), 2, rule=_WIDTHS, cell_rows=WIDE_ROWS).report_boxes(_query_boxes(spark, sf))


@query(f"SELECT q.id AS qid, p.id, p.c0, p.c1 FROM pts q JOIN pts p ON {_IN_BALL}", "pts")
def range_report_ball(spark, sf):
    return CellTable(V.parts(spark, sf), 2, cell_rows=WIDE_ROWS).report_balls(_query_balls(spark, sf))


_OPEN_OWN = "p.c0 > b.lo0 AND p.c0 < b.hi0 AND p.c1 > b.lo1 AND p.c1 < b.hi1"


@query(_OWN + f"SELECT b.id AS qid, p.id, p.c0, p.c1 FROM own b JOIN pts p ON {_OPEN_OWN} WHERE b.id % 10 = 0", "pts")
def range_report_open_box(spark, sf):
    return CellTable(V.parts(spark, sf), 2, rule=_WIDTHS).report_boxes(_query_boxes(spark, sf).where("qid % 10 = 0"), open_=True)


@query(_MATES + "SELECT m.qid, count(p.id) AS cnt FROM mates m LEFT JOIN pts p ON p.c0 BETWEEN least(a0, b0) AND greatest(a0, b0) AND p.c1 BETWEEN least(a1, b1) AND greatest(a1, b1) GROUP BY m.qid", "pts")
def range_count_pairs(spark, sf):
    points = V.parts(spark, sf)
    return CellTable(points, 2).count_in_boxes(workloads.pair_boxes(points, 2))


@query(_MATES + ", balls AS (SELECT qid, a0, a1, CAST(floor(sqrt(CAST((a0 - b0) * (a0 - b0) + (a1 - b1) * (a1 - b1) AS DOUBLE))) AS BIGINT) AS r FROM mates) SELECT m.qid, count(p.id) AS cnt FROM balls m LEFT JOIN pts p ON (p.c0 - a0) * (p.c0 - a0) + (p.c1 - a1) * (p.c1 - a1) <= r * r GROUP BY m.qid", "pts")
def range_count_pair_balls(spark, sf):
    points = V.parts(spark, sf)
    return CellTable(points, 2).count_in_balls(workloads.pair_balls(points, 2))


@query(_LINE_BOXES + "SELECT b.qid, count(p.c0) AS cnt FROM own b LEFT JOIN lines p ON p.c0 BETWEEN lo0 AND hi0 AND p.c1 BETWEEN lo1 AND hi1 AND p.c2 BETWEEN lo2 AND hi2 GROUP BY b.qid", "lines")
def cell_range_count_3d(spark, sf):
    p = V.parts(spark, sf)
    boxes = p.select(F.col("id").alias("qid"), (F.col("c0") - 1).alias("lo0"), (F.col("c0") + 1).alias("hi0"), (F.col("c1") * 10).alias("lo1"), (F.col("c1") * 12).alias("hi1"), F.lit(2).cast("long").alias("lo2"), F.lit(6).cast("long").alias("hi2"))
    return CellTable(V.lines(spark, sf), 3).count_in_boxes(boxes)


def _bracketed(kind):
    def run(spark, sf):
        points = V.parts(spark, sf)
        low, high = workloads.bracket(kind, points.count())
        boxes = workloads.rectangles(points, 2, kind, 100)
        counted = CellTable(points, 2).count_in_boxes(boxes).join(boxes.select("qid", "expected"), "qid")
        return counted.select("qid", (F.col("cnt") == F.col("expected")).alias("exact"), F.col("expected").between(low, high).alias("in_bracket"))

    run.__name__ = f"range_{kind}"
    return query("SELECT CAST(i AS BIGINT) AS qid, true AS exact, true AS in_bracket FROM range(100) t(i)")(run)


range_small, range_medium, range_large = map(_bracketed, ("small", "medium", "large"))


@query("SELECT CAST(i AS BIGINT) AS qid, true AS whole, least(50, (SELECT count(*) FROM part)) AS expected FROM range(40) t(i)")
def range_morton(spark, sf):
    points = V.parts(spark, sf)
    boxes = workloads.morton_rectangles(points, 2, 40, 50)
    return CellTable(points, 2).count_in_boxes(boxes).join(boxes.select("qid", "expected"), "qid").select("qid", (F.col("cnt") >= F.col("expected")).alias("whole"), "expected")

# ---------------------------------------------------------------- updates


def _first_tenth(spark, sf):
    return updates.fraction(V.parts(spark, sf), 0.1)


_TENTH = "id < CAST(floor((SELECT count(*) FROM pts) * 0.1) AS BIGINT)"


@query("SELECT id, c0, c1 FROM pts UNION ALL SELECT id, c0, c1 FROM cust", "pts", "cust")
def batch_insert(spark, sf):
    return updates.insert(V.parts(spark, sf), V.customers(spark, sf))


@query("SELECT id, c0, c1 FROM pts UNION ALL SELECT -1, 7, 7", "pts")
def point_insert(spark, sf):
    one = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(7).cast("long").alias("c0"), F.lit(7).cast("long").alias("c1"))
    return updates.insert(V.parts(spark, sf), one)


@query(f"SELECT * FROM pts EXCEPT ALL SELECT * FROM pts WHERE {_TENTH}", "pts")
def batch_delete_strict(spark, sf):
    return updates.delete_strict(V.parts(spark, sf), _first_tenth(spark, sf))


@query("SELECT c0, c2 AS c1 FROM lines EXCEPT ALL (SELECT c0, c2 AS c1 FROM lines WHERE c1 < 2000000 UNION ALL SELECT 999, 999)", "lines")
def batch_delete_lenient(spark, sf):
    bag = V.lines(spark, sf)
    absent = spark.range(1).select(F.lit(999).cast("long").alias("c0"), F.lit(999).cast("long").alias("c1"))
    gone = bag.where("c1 < 2000000").select("c0", F.col("c2").alias("c1")).unionAll(absent)
    return updates.delete_lenient(bag.select("c0", F.col("c2").alias("c1")), gone)


@query("SELECT * FROM pts WHERE id <> 1", "pts")
def point_delete(spark, sf):
    points = V.parts(spark, sf)
    return updates.delete_strict(points, points.where("id = 1"))


@query("SELECT id, c0, c1 FROM (SELECT p.*, row_number() OVER (PARTITION BY p.c0, p.c1 ORDER BY p.id) AS r, coalesce(g.n, 0) AS n FROM pts p LEFT JOIN (SELECT c0, c1, count(*) AS n FROM pts WHERE id % 3 = 0 GROUP BY ALL) g ON p.c0 = g.c0 AND p.c1 = g.c1) WHERE r > n", "pts")
def delete_by_coordinates(spark, sf):
    points = V.parts(spark, sf)
    return updates.delete_by_coordinates(points, points.where("id % 3 = 0"), 2)


@query(_knn_sql(10, f"{_PAIRS} FROM (SELECT * FROM pts UNION ALL SELECT id + 1000000000, c0, c1 FROM cust) p, pts q WHERE q.id % 100 = 0"), "pts", "cust")
def knn_after_insert(spark, sf):
    points = V.parts(spark, sf)
    more = V.customers(spark, sf).withColumn("id", F.col("id") + 1_000_000_000)
    return updates.SpatialTable(points, 2).insert(more).knn(_asking(points), 10)


@query(_knn_sql(10, f"{_PAIRS} FROM (SELECT * FROM pts WHERE NOT ({_TENTH})) p, pts q WHERE q.id % 100 = 0"), "pts")
def knn_after_delete(spark, sf):
    points = V.parts(spark, sf)
    return updates.SpatialTable(points, 2).delete(_first_tenth(spark, sf)).knn(_asking(points), 10)


@query(_OWN + f", live AS (SELECT * FROM pts WHERE NOT ({_TENTH}) UNION ALL SELECT id, c0, c1 FROM cust) SELECT b.id AS qid, count(p.id) AS cnt FROM own b LEFT JOIN live p ON {_IN_OWN} GROUP BY b.id", "pts", "cust")
def count_after_update(spark, sf):
    table = updates.SpatialTable(V.parts(spark, sf), 2).insert(V.customers(spark, sf)).delete(_first_tenth(spark, sf), strict=False)
    return table.count_in_boxes(_query_boxes(spark, sf))


@query("SELECT * FROM pts", "pts")
def incremental_build(spark, sf):
    return updates.incremental_build(updates.slices(V.parts(spark, sf), 0.2))


@query("SELECT * FROM cust", "pts", "cust")
def incremental_delete(spark, sf):
    p = V.parts(spark, sf)
    return updates.incremental_delete(updates.insert(p, V.customers(spark, sf)), updates.slices(p, 0.25))


@query(_knn_sql(1, f"{_PAIRS} FROM pts p, pts q WHERE q.id % 100 = 0 AND p.{_TENTH}"), "pts")
def prefix_query(spark, sf):
    points = V.parts(spark, sf)
    return replay.prefix_knn(points, _asking(points), int(points.count() * 0.1), 1, 2)


# ---------------------------------------------------------------- periods

_LIVE = "+nums AS (SELECT period, row_number() OVER (ORDER BY period) AS r FROM (SELECT DISTINCT period FROM years)), live AS (SELECT b.period AS at_period, y.* FROM years y JOIN nums a ON a.period = y.period JOIN nums b ON b.r BETWEEN a.r AND a.r + 4) "


@query("SELECT period, count(*) AS cnt FROM years GROUP BY period", "years")
def period_counts(spark, sf):
    return replay.period_counts(V.order_years(spark, sf))


@query("SELECT period, count(*) AS cnt FROM days GROUP BY period", "days")
def period_counts_daily(spark, sf):
    return replay.period_counts(V.event_days(spark, sf))


@query("SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS period, count(*) AS cnt FROM orders GROUP BY ALL")
def period_counts_monthly(spark, sf):
    t = F.col("o_orderdate")
    return replay.period_counts(V.table(spark, sf, "orders").select((F.year(t) * 100 + F.month(t)).alias("period")))


@query("SELECT period AS at_period, CAST(sum(n) OVER (ORDER BY period ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS cnt FROM (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS period, count(*) AS n FROM orders GROUP BY ALL)")
def sliding_window_count_monthly(spark, sf):
    t = F.col("o_orderdate")
    return replay.window_counts(V.table(spark, sf, "orders").select((F.year(t) * 100 + F.month(t)).alias("period")))


@query("SELECT DISTINCT o_orderkey, o_custkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def dedup_slice_period(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return replay.deduplicated_slice(rows, rows.columns, "o_orderdate", "1994-01-01", "1997-01-01")


@query(_LIVE + "SELECT at_period, period, id, c0, c1 FROM live", "years")
def sliding_window_contents(spark, sf):
    return replay.live_rows(V.order_years(spark, sf)).select("at_period", "period", "id", "c0", "c1")


@query("SELECT period AS at_period, CAST(sum(n) OVER (ORDER BY period ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS cnt FROM (SELECT period, count(*) AS n FROM days GROUP BY period)", "days")
def sliding_window_count(spark, sf):
    return replay.window_counts(V.event_days(spark, sf))


@query(_LIVE + "SELECT at_period, qid, nid, dist2, rk FROM (SELECT *, row_number() OVER (PARTITION BY at_period, qid ORDER BY dist2, nid) AS rk FROM (SELECT p.at_period, q.id AS qid, p.id AS nid, (p.c0 - q.c0) * (p.c0 - q.c0) + (p.c1 - q.c1) * (p.c1 - q.c1) AS dist2 FROM live p, years q WHERE q.id % 100 = 0)) WHERE rk <= 10", "years")
def sliding_window_knn(spark, sf):
    periods = V.order_years(spark, sf)
    return replay.window_knn(periods, _asking(periods), 10, 2)


# ---------------------------------------------------------------- layout

#: Constant splits, so that SQL can name the cells.
_SPLIT = Split(0, 25, Split(1, 95_000, Split(0, 12, Split(), Split()), Split()), Split(1, 93_000, Split(), Split(1, 97_000, Split(), Split())))
_CELLS = "+cells AS (SELECT *, CAST(CASE WHEN c0 < 25 THEN CASE WHEN c1 < 95000 THEN CASE WHEN c0 < 12 THEN 8 ELSE 9 END ELSE 5 END ELSE CASE WHEN c1 < 93000 THEN 6 ELSE CASE WHEN c1 < 97000 THEN 14 ELSE 15 END END END AS BIGINT) AS cell FROM pts) "


def _fixed_cells(spark, sf):
    return CellTable(V.parts(spark, sf), 2, split=_SPLIT)


@query(_CELLS + "SELECT cell, count(*) AS cnt FROM cells GROUP BY cell", "pts")
def cell_histogram(spark, sf):
    return _fixed_cells(spark, sf).cells.select("cell", "cnt")


@query(_CELLS + "SELECT cell, min(c0) AS lo0, min(c1) AS lo1, max(c0) AS hi0, max(c1) AS hi1 FROM cells GROUP BY cell", "pts")
def cell_mbr(spark, sf):
    return _fixed_cells(spark, sf).cells.drop("cnt")


@query(_CELLS + ", nodes AS (SELECT cell >> h AS node, count(*) AS cnt FROM cells, range(0, 4) t(h) WHERE cell >> h > 0 GROUP BY ALL) SELECT node, cnt FROM nodes", "pts")
def cell_rollup(spark, sf):
    return _fixed_cells(spark, sf).rolled_up()


@query(_CELLS + ", nodes AS (SELECT cell >> h AS node, count(*) AS cnt FROM cells, range(0, 4) t(h) WHERE cell >> h > 0 GROUP BY ALL) SELECT n.node, n.cnt, coalesce(l.cnt, 0) AS left_cnt, n.cnt = 0 OR floor(abs(100.0 * coalesce(l.cnt, 0) / n.cnt - 50.0)) > 30 AS unbalanced FROM nodes n LEFT JOIN nodes l ON l.node = 2 * n.node WHERE n.node NOT IN (SELECT cell FROM cells)", "pts")
def cell_imbalance(spark, sf):
    return _fixed_cells(spark, sf).imbalance()


@query(_CELLS + "SELECT CAST(max(d) AS BIGINT) AS max_depth, avg(d) AS mean_depth, count(*) AS cells FROM (SELECT floor(log2(cell)) AS d FROM (SELECT DISTINCT cell FROM cells))", "pts")
def leaf_depth(spark, sf):
    return _fixed_cells(spark, sf).depth_stats()


@query(_CELLS + "SELECT cell, CASE WHEN n < 400 AND cell > 1 THEN cell >> 1 ELSE cell END AS merged, n AS cnt FROM (SELECT cell, count(*) AS n FROM cells GROUP BY cell)", "pts")
def thin_cells(spark, sf):
    return _fixed_cells(spark, sf).thin(400)


#: The cells on record lack a tenth of the points.
@query(_CELLS + ", rec AS (SELECT cell, count(*) AS cnt, min(c0) AS lo0, max(c0) AS hi0, min(c1) AS lo1, max(c1) AS hi1 FROM cells WHERE id % 10 <> 0 GROUP BY cell) SELECT cell, count(*) AS seen, count(*) FILTER (NOT (c0 BETWEEN lo0 AND hi0 AND c1 BETWEEN lo1 AND hi1)) AS outside, max(cnt) AS cnt FROM cells JOIN rec USING (cell) GROUP BY cell HAVING count(*) <> max(cnt) OR count(*) FILTER (NOT (c0 BETWEEN lo0 AND hi0 AND c1 BETWEEN lo1 AND hi1)) > 0", "pts")
def layout_violations(spark, sf):
    points = V.parts(spark, sf)
    recorded = CellTable(points.where("id % 10 <> 0"), 2, split=_SPLIT).cells
    return CellTable(points, 2, split=_SPLIT, cells=recorded).violations()


@query("SELECT CAST(7 AS BIGINT) AS cell, 1 AS dim, 0 AS expected")
def rotation_violations(spark, sf):
    return _fixed_cells(spark, sf).rotation_violations()


@query("SELECT count(*) AS cnt, min(c0) AS lo0, min(c1) AS lo1, max(c0) AS hi0, max(c1) AS hi1 FROM (SELECT c0, c1 FROM pts UNION ALL SELECT c0, c1 FROM cust)", "pts", "cust")
def root_box(spark, sf):
    return updates.SpatialTable(V.parts(spark, sf), 2).insert(V.customers(spark, sf)).root()


@query(_CELLS + "SELECT CAST(floor(log2(cell)) AS BIGINT) AS depth, cnt, count(*) AS cells FROM (SELECT cell, count(*) AS cnt FROM cells GROUP BY cell) GROUP BY ALL", "pts")
def leaf_histogram(spark, sf):
    return _fixed_cells(spark, sf).leaf_histogram()


@query(_CELLS + ", " + _OWN.lstrip("+") + ", rec AS (SELECT cell, min(c0) AS l0, max(c0) AS h0, min(c1) AS l1, max(c1) AS h1 FROM cells GROUP BY cell) SELECT id AS qid, count(*) FILTER (l0 <= hi0 AND h0 >= lo0 AND l1 <= hi1 AND h1 >= lo1 AND NOT (l0 >= lo0 AND h0 <= hi0 AND l1 >= lo1 AND h1 <= hi1)) AS cells FROM own, rec GROUP BY id", "pts")
def range_visited_cells(spark, sf):
    return _fixed_cells(spark, sf).visited_boxes(_query_boxes(spark, sf)).select("qid", "cells")


@query(_CELLS + ", both_ AS (SELECT cell FROM cells UNION ALL SELECT CASE WHEN c0 < 25 THEN CASE WHEN c1 < 95000 THEN CASE WHEN c0 < 12 THEN 8 ELSE 9 END ELSE 5 END ELSE CASE WHEN c1 < 93000 THEN 6 ELSE CASE WHEN c1 < 97000 THEN 14 ELSE 15 END END END FROM cust), nodes AS (SELECT CAST(cell AS BIGINT) >> h AS node, count(*) AS cnt FROM both_, range(0, 4) t(h) WHERE CAST(cell AS BIGINT) >> h > 0 GROUP BY ALL), inner_ AS (SELECT n.cnt, coalesce(l.cnt, 0) AS left_cnt FROM nodes n LEFT JOIN nodes l ON l.node = 2 * n.node WHERE n.node NOT IN (SELECT cell FROM both_)) SELECT CAST(ratio AS BIGINT) AS ratio, count(*) AS nodes, count(*) FILTER (floor(abs(100.0 * left_cnt / cnt - 50.0)) > ratio) AS unbalanced FROM inner_, (VALUES (2), (5), (10), (20), (30), (40)) r(ratio) GROUP BY ratio", "pts", "cust")
def balance_study(spark, sf):
    points = V.parts(spark, sf)
    table = updates.SpatialTable(points, 2, CellTable(points, 2, split=_SPLIT))
    return replay.balance(table, V.customers(spark, sf), (2, 5, 10, 20, 30, 40))


@query(_knn_sql(10), "pts")
def cell_knn(spark, sf):
    points = V.parts(spark, sf)
    return CellTable(points, 2, levels=8, rule="rotate").knn(_asking(points), 10)


_MORTON = " | ".join(f"(((c{i} >> {b}) & 1) << {2 * b + i})" for b in range(24) for i in range(2))


@query(f"SELECT id, {_MORTON} AS z FROM pts", "pts")
def zorder_key(spark, sf):
    return zorder.with_key(V.parts(spark, sf), 2, 24).select("id", "z")


@query(f"SELECT id, row_number() OVER (ORDER BY z, id) - 1 AS place FROM (SELECT id, {_MORTON} AS z FROM pts)", "pts")
def zorder_sort_rank(spark, sf):
    keyed = zorder.with_key(V.parts(spark, sf), 2, 24)
    return text.with_row_index(keyed.repartitionByRange("z", "id").sortWithinPartitions("z", "id"), "place").select("id", "place")


@query(f"SELECT place // 100 AS run, count(*) AS cnt, min(c0) AS lo0, min(c1) AS lo1, max(c0) AS hi0, max(c1) AS hi1 FROM (SELECT c0, c1, row_number() OVER (ORDER BY z, id) - 1 AS place FROM (SELECT id, c0, c1, {_MORTON} AS z FROM pts)) GROUP BY ALL", "pts")
def zorder_run_boxes(spark, sf):
    return zorder.runs(V.parts(spark, sf), 2, 100)


# ---------------------------------------------------------------- graphs

_GRAPH = f"+edges AS (SELECT qid AS src, nid AS dst, dist2 AS w FROM ({_knn_sql(3, f'{_PAIRS} FROM pts p, pts q')})) "


def _neighbour_graph(spark, sf):
    points = V.parts(spark, sf)
    return knn.knn_graph(CellTable(points, 2).knn(workloads.as_queries(points, 2), 3))


@query(_GRAPH + "SELECT src, dst, w FROM edges", "pts")
def knn_graph_edges(spark, sf):
    return _neighbour_graph(spark, sf)


@query(_GRAPH + "SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst", "pts")
def graph_symmetrize(spark, sf):
    return graphs.symmetrized(_neighbour_graph(spark, sf))


@query(_GRAPH + "SELECT dst AS src, count(*) AS degree FROM edges GROUP BY dst", "pts")
def graph_degrees(spark, sf):
    return graphs.degrees(_neighbour_graph(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(_GRAPH + "SELECT greatest(max(src), max(dst)) + 1 AS n FROM edges", "pts")
def graph_vertex_count(spark, sf):
    return graphs.vertex_count(_neighbour_graph(spark, sf))


@query(_GRAPH + "SELECT id AS src, CAST(sum(d) OVER (ORDER BY id) - d AS BIGINT) AS start, d AS degree FROM (SELECT p.id, count(e.dst) AS d FROM pts p LEFT JOIN (SELECT dst AS src, src AS dst FROM edges) e ON e.src = p.id GROUP BY p.id)", "pts")
def graph_csr_offsets(spark, sf):
    reverse = _neighbour_graph(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graphs.csr_offsets(reverse, V.parts(spark, sf).select(F.col("id").alias("src")))


@query(_GRAPH + "SELECT DISTINCT dst AS v FROM edges WHERE src % 100 = 0 AND dst % 2 = 0", "pts")
def frontier_step(spark, sf):
    frontier = V.parts(spark, sf).where("id % 100 = 0").select(F.col("id").alias("v"))
    return graphs.frontier_step(frontier, _neighbour_graph(spark, sf), F.col("dst") % 2 == 0)


#: Two triangles for each order line position: (k, k+1, m+k) and (k+1, m+k+1, m+k), a strip.
@query("WITH t AS (SELECT 2 * (p_partkey - 1) AS tri, p_partkey AS a, p_partkey + 1 AS b, p_partkey + 1000000000 AS c FROM part UNION ALL SELECT 2 * (p_partkey - 1) + 1, p_partkey + 1, p_partkey + 1000000001, p_partkey + 1000000000 FROM part), s AS (SELECT tri, 0::BIGINT AS side, a AS u, b AS v FROM t UNION ALL SELECT tri, 1, b, c FROM t UNION ALL SELECT tri, 2, c, a FROM t) SELECT x.tri, x.side, y.tri AS other FROM s x JOIN s y ON x.u = y.v AND x.v = y.u")
def triangle_neighbours(spark, sf):
    k = F.col("p_partkey")
    part = V.table(spark, sf, "part")
    far = 1_000_000_000
    lower = part.select((2 * (k - 1)).alias("tri"), k.alias("a"), (k + 1).alias("b"), (k + far).alias("c"))
    upper = part.select((2 * (k - 1) + 1).alias("tri"), (k + 1).alias("a"), (k + far + 1).alias("b"), (k + far).alias("c"))
    return graphs.triangle_neighbours(lower.unionAll(upper))


# ---------------------------------------------------------------- logs


@query("SELECT l_returnflag, l_linestatus, avg(CASE WHEN l_linenumber <> -1 THEN l_linenumber END) AS l_linenumber FROM lineitem GROUP BY ALL")
def log_merge(spark, sf):
    return logs.merged(V.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_linenumber"])


@query("SELECT l_returnflag, avg(l_linenumber) AS avg_l_linenumber, max(l_linenumber) AS max_l_linenumber FROM lineitem GROUP BY ALL")
def log_mean_max(spark, sf):
    return logs.mean_and_max(V.table(spark, sf, "lineitem"), "l_returnflag", ["l_linenumber"])
