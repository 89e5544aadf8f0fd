"""Properties that need no oracle, and edge cases."""

import random

import pytest

from quadrille.functions import geometry as G
from quadrille.operators import aggregates, graphs, knn, logs, ranges, updates, workloads, zorder
from quadrille.operators.cells import CellTable, split_sample
from quadrille.plans import views as V
from quadrille.sources import generators

POINTS = "id long, c0 long, c1 long"


def bag(frame):
    return sorted(map(tuple, frame.collect()))


def made(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], POINTS)


FIXTURES = {
    "empty": [],
    "single": [(3, 4)],
    "all_same": [(5, 5)] * 100,
    "collinear": [(k, 7) for k in range(50)],
    "ties": [(1, 0), (-1, 0), (0, 1), (0, -1)],
    "n_lt_k": [(k, k * k) for k in range(5)],
    "random": [(random.Random(k).randrange(100), random.Random(-k).randrange(30)) for k in range(400)],
}


@pytest.mark.parametrize("name", FIXTURES)
def test_pruned_joins_equal_full_ones(spark, name):
    points = made(spark, FIXTURES[name])
    asking = spark.createDataFrame([(0, 5, 5), (1, 0, 0), (2, 10_000, -10_000), (3, 7, 7)], "qid long, q0 long, q1 long")
    boxes = spark.createDataFrame([(0, 5, 5, 5, 5), (1, 0, 0, 49, 7), (2, 9, 9, 1, 1), (3, -5, -5, 200, 200), (4, 1, 0, 1, 0)], "qid long, lo0 long, lo1 long, hi0 long, hi1 long")
    balls = asking.selectExpr("*", "cast(qid * 5 as bigint) as r")
    for rule in ("widest", "rotate"):
        cells = CellTable(points, 2, levels=4, rule=rule)
        assert bag(cells.knn(asking, 10)) == bag(knn.brute_knn(asking, points, 10, 2))
        own = workloads.as_queries(points, 2)
        assert bag(cells.knn(own, 3, exclude_self=True)) == bag(knn.brute_knn(own, points, 3, 2, exclude_self=True))
        assert bag(cells.count_in_boxes(boxes)) == bag(ranges.count_in_boxes(boxes, points, 2))
        assert bag(cells.count_in_balls(balls)) == bag(ranges.count_in_balls(balls, points, 2))
        assert bag(cells.report_boxes(boxes)) == bag(ranges.report_boxes(boxes, points, 2))
        assert cells.violations().count() == 0
    counts = {r.qid: r.cnt for r in ranges.count_in_boxes(boxes, points, 2).collect()}
    reported = {}
    for r in ranges.report_boxes(boxes, points, 2).collect():
        reported[r.qid] = reported.get(r.qid, 0) + 1
    assert counts == {q: reported.get(q, 0) for q in range(5)} and counts[2] == 0


def test_ties_rank_by_id_and_small_tables_give_all(spark):
    points = made(spark, FIXTURES["ties"])
    q = spark.createDataFrame([(9, 0, 0)], "qid long, q0 long, q1 long")
    assert [r.nid for r in knn.brute_knn(q, points, 3, 2).orderBy("rk").collect()] == [0, 1, 2]
    assert CellTable(points, 2).knn(q, 10).count() == 4


def test_updates(spark):
    p, q = made(spark, FIXTURES["random"]), made(spark, FIXTURES["collinear"]).selectExpr("id + 1000 as id", "c0", "c1")
    both = updates.insert(p, q)
    assert bag(updates.delete_strict(both, q)) == bag(p)
    assert bag(updates.delete_lenient(p, q)) == bag(p)
    with pytest.raises(updates.AbsentPoints):
        updates.delete_strict(p, q)
    same = spark.createDataFrame([(5, 5)] * 100, "c0 long, c1 long")
    assert updates.delete_strict(same, same.limit(40)).count() == 60
    assert updates.delete_lenient(same, same.unionAll(same)).count() == 0
    assert bag(updates.incremental_build(updates.slices(p, 0.1), every=3)) == bag(p)
    assert bag(updates.incremental_delete(both, [q], strict=True)) == bag(p)
    assert bag(updates.fraction(p, 0.25)) == bag(p)[:100]


def test_table_after_updates_equals_a_fresh_one(spark):
    p, q = made(spark, FIXTURES["random"]), made(spark, [(k % 7 + 500, k) for k in range(300)]).selectExpr("id + 1000 as id", "c0", "c1")
    table = updates.SpatialTable(p, 2).insert(q).delete(updates.fraction(p, 0.5))
    fresh = updates.SpatialTable(table.points, 2)
    asking = workloads.as_queries(q, 2)
    assert bag(table.knn(asking, 4)) == bag(fresh.knn(asking, 4))
    assert table.validate().count() == 0
    assert bag(table.rebalanced().points) == bag(table.points)
    assert table.clear().points.count() == 0


def test_generated_rectangles_hold_their_counts(spark):
    points = generators.clustered(spark, 3000, 2)
    for kind in workloads.BRACKETS:
        boxes = workloads.rectangles(points, 2, kind, 20)
        low, high = workloads.bracket(kind, 3000)
        assert boxes.count() and all(low <= r.expected <= high for r in boxes.collect())
        counts = CellTable(points, 2).count_in_boxes(boxes)
        assert ranges.disagreements(counts, boxes.select("qid", "expected")).count() == 0


def test_counts_over_disjoint_boxes_add_up(spark):
    points = generators.uniform(spark, 2000, 2, 0, 99)
    boxes = spark.createDataFrame([(10 * i + j, 10 * i, 10 * j, 10 * i + 9, 10 * j + 9) for i in range(10) for j in range(10)], "qid long, lo0 long, lo1 long, hi0 long, hi1 long")
    assert sum(r.cnt for r in CellTable(points, 2).count_in_boxes(boxes).collect()) == 2000


def test_pruning_reads_few_cells(spark):
    points = generators.uniform(spark, 20_000, 2)
    cells = CellTable(points, 2)
    asking = workloads.as_queries(points.where("id % 100 = 0"), 2)
    assert cells.visited(asking, 10).first().mean_cells < 8
    plan = cells.knn(asking, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_far_and_shifted_queries(spark):
    points = generators.uniform(spark, 1000, 3)
    for q in (workloads.cloud(spark, points, 3, 20, 100), workloads.shifted(workloads.as_queries(points, 3), points, 3, 10)):
        p = points.selectExpr("id", *[f"cast(c{i} as double) as c{i}" for i in range(3)]) if dict(q.dtypes)["q0"] == "double" else points
        assert bag(CellTable(p, 3).knn(q, 2)) == bag(knn.brute_knn(q, p, 2, 3))


def test_aggregates(spark):
    p = made(spark, FIXTURES["random"])
    assert aggregates.all_identical(made(spark, FIXTURES["all_same"]), 2).first().same
    assert not aggregates.all_identical(p, 2).first().same
    assert aggregates.bounding_box(made(spark, []), 2).first().lo0 is None
    assert aggregates.upper_median(p, "c0").first().median == sorted(r.c0 for r in p.collect())[200]
    assert bag(aggregates.expanded(aggregates.multiplicities(p, 2))) == bag(p.select("c0", "c1"))


def test_bigint_overflow_is_an_error(spark):
    points = made(spark, [(2**40, 0)])
    q = spark.createDataFrame([(0, -(2**40), 0)], "qid long, q0 long, q1 long")
    with pytest.raises(Exception, match="OVERFLOW"):
        knn.brute_knn(q, points, 1, 2).collect()


def test_expressions(spark):
    from pyspark.sql import functions as F

    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    a, b, c = lit(0, 0), lit(4, 0), lit(0, 4)
    row = spark.range(1).select(
        G.triangle_area2(a, b, c).alias("area"), G.counter_clockwise(a, b, c).alias("ccw"), G.in_circle(a, b, c, lit(2, 2)).alias("inside"), G.in_circle(a, b, c, lit(5, 5)).alias("outside"),
        G.angle(a, b, c).alias("angle"), G.min_angle(a, b, c).alias("least"), *[x.alias(f"cc{i}") for i, x in enumerate(G.circumcentre(a, b, c))],
        G.orthant(lit(1, -1, 3), lit(0, 0, 0)).alias("orthant"), G.outside_cube(lit(1, 2), a, F.lit(1.5)).alias("out"), G.dot(lit(1, 2, 3), lit(4, 5, 6)).alias("dot"), G.length(lit(3, 4)).alias("length"),
        F.array(*G.cross(lit(1, 0, 0), lit(0, 1, 0))).alias("cross"), G.bit_is_low(F.lit(4), 3).alias("low"), G.bit_is_low(F.lit(5), 3).alias("high"), G.imbalanced(F.lit(10), F.lit(100)).alias("off"), G.imbalanced(F.lit(0), F.lit(0)).alias("none"),
        F.array(*G.scaled(G.added(lit(1, 2), G.subtracted(lit(5, 5), lit(2, 3))), F.lit(2.0))).alias("sum"), G.array_dist2(F.array(*lit(1, 2)), F.array(*lit(4, 6))).alias("d"),
    ).first()
    assert (row.area, row.ccw, row.inside, row.outside, round(row.angle), round(row.least), row.cc0, row.cc1) == (16, True, True, False, 90, 45, 2, 2)
    assert (row.orthant, row.out, row.dot, row.length, row.cross, row.low, row.high, row.off, row.none, row.sum, row.d) == (5, True, 32, 5, [0, 0, 1], 1, 0, True, True, [8, 8], 25)


def test_morton_layout(spark):
    points = generators.uniform(spark, 500, 3, -50, 50)
    keyed = zorder.with_scaled_key(points, 3)
    assert keyed.columns == [*points.columns, "z"] and keyed.where("z < 0").count() == 0
    assert bag(zorder.sorted_by_key(keyed, 4).drop("z")) == bag(points)


def test_graphs(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 2), (0, 3), (0, 3)], "src long, dst long")
    assert bag(graphs.distinct_edges(edges)) == [(0, 1), (0, 3), (1, 0), (1, 2), (2, 2)]
    assert bag(graphs.symmetrized(edges)) == [(0, 1), (0, 3), (1, 0), (1, 2), (2, 1), (3, 0)]
    assert bag(graphs.edges_of(graphs.adjacency(edges))) == bag(edges)
    assert bag(graphs.csr_offsets(edges, spark.range(5).withColumnRenamed("id", "src"))) == [(0, 0, 3), (1, 3, 2), (2, 5, 1), (3, 6, 0), (4, 6, 0)]
    assert graphs.consistent(edges, 4).count() == 0 and graphs.consistent(edges, 3).count() == 2
    assert graphs.vertex_count(edges.limit(0)).first().n == 0
    assert sorted(r.place for r in graphs.permuted(edges).collect()) == list(range(6))
    assert all(0 <= r.w < 1 for r in graphs.with_weights(edges).collect())


def test_delaunay(spark):
    square = spark.createDataFrame([(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 4.0, 1.0), (3, 0.0, 1.1)], "id long, c0 double, c1 double")
    good, bad = [(0, 0, 1, 3), (1, 1, 2, 3)], [(0, 0, 1, 2), (1, 0, 2, 3)]
    found = [graphs.delaunay_violations(square, spark.createDataFrame(t, "tri long, a long, b long, c long")).count() for t in (good, bad)]
    assert sorted(found) == [0, 2]


def test_workload_runner(spark, tmp_path):
    from quadrille.plans import workload
    from quadrille.sources import text

    text.write_points(generators.uniform(spark, 400, 2, 0, 999), f"{tmp_path}/1.in", 2)
    text.write_points(generators.clustered(spark, 300, 2), f"{tmp_path}/2.in", 2)
    mask = sum(1 << b for b in (0, 2, 3, 4, 5, 6, 7, 8, 9, 15, 17))
    found = workload.run(spark, f"{tmp_path}/1.in", dim=2, tag=2, rounds=1, mask=mask, k=3, other=f"{tmp_path}/2.in", ratios=(0.1,), steps=(0.5,))
    names = [r["metric"] for r in found]
    assert {"build", "insert", "delete", "knn", "range_count_small", "range_report_large", "insert_0.1", "delete_0.1", "incremental_build_0.5", "incremental_delete_0.5", "knn_after_build_0.5", "knn_after_delete_0.5", "knn_far_100", "knn_foreign"} <= set(names)
    assert all(r["seconds"] >= 0 and r["rows"] >= 0 for r in found)


def test_logs(spark):
    lines = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, -1.0), ("b", -1.0, -1.0)], "solver string, build double, knn double")
    assert bag(logs.merged(lines, ["solver"], ["build", "knn"]).orderBy("solver")) == [("a", 2.0, 2.0), ("b", None, None)]


def test_splits_separate_equal_values():
    split = split_sample([(1, 1)] * 50 + [(2, 1)] * 3, 2, 3)
    assert split.dim == 0 and split.at == 2 and split.left.left is None


def test_views_have_no_repeated_ids(spark, sf_dir):
    p = V.parts(spark, sf_dir)
    assert p.select("id").distinct().count() == p.count()


@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000])
def test_rows_read_by_a_search_dont_grow_with_the_table(spark, n):
    points = generators.uniform(spark, n, 2)
    cells = CellTable(points, 2)
    assert abs(cells.cells.count() - n / 3000) < n / 1500 + 4
    asking = workloads.as_queries(points.where(f"id % {n // 100} = 0"), 2)
    largest = cells.cells.agg({"cnt": "max"}).first()[0]
    assert largest < 8192 and cells.visited(asking, 10).first().mean_cells < 3


def test_written_layout_is_read_back_and_pruned(spark, tmp_path):
    points = generators.uniform(spark, 50_000, 2, 0, 99_999)
    cells = CellTable(points, 2, cell_rows=512)
    cells.write(f"{tmp_path}/layout")
    kept = CellTable.read(spark, f"{tmp_path}/layout")
    box = spark.createDataFrame([(0, 100, 100, 9000, 9000)], "qid long, lo0 long, lo1 long, hi0 long, hi1 long")
    asking = workloads.as_queries(points.where("id % 5000 = 0"), 2)
    assert bag(kept.count_in_boxes(box)) == bag(ranges.count_in_boxes(box, points, 2))
    assert bag(kept.report_boxes(box)) == bag(ranges.report_boxes(box, points, 2))
    assert bag(kept.knn(asking, 5)) == bag(knn.brute_knn(asking, points, 5, 2))
    plan = kept.report_boxes(box)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [IsNotNull(cell), In(cell" in plan or "cell IN" in plan


def test_hot_cells_are_dealt_to_a_grid(spark, monkeypatch):
    from quadrille.operators import cells as module

    monkeypatch.setattr(module, "PART_ROWS", 40)
    monkeypatch.setattr(module, "PACK_ROWS", 30)
    points = made(spark, FIXTURES["random"] + [(50, 15)] * 200)
    cells, asking = CellTable(points, 2, levels=2), workloads.as_queries(points, 2)
    boxes = points.selectExpr("id as qid", "c0 - 2 as lo0", "c1 - 2 as lo1", "c0 + 2 as hi0", "c1 + 2 as hi1")
    assert bag(cells.knn(asking, 7)) == bag(knn.brute_knn(asking, points, 7, 2))
    assert bag(cells.count_in_boxes(boxes)) == bag(ranges.count_in_boxes(boxes, points, 2))
    assert bag(cells.report_boxes(boxes)) == bag(ranges.report_boxes(boxes, points, 2))


def test_a_small_delete_moves_no_other_rows(spark):
    points = made(spark, FIXTURES["random"])
    out = updates.delete_lenient(points, points.where("id < 5"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    nulls = spark.createDataFrame([(1, None, 2), (1, None, 2), (1, None, 2), (2, 3, None)], POINTS)
    assert bag(updates.delete_strict(nulls, nulls.limit(1).unionAll(nulls.where("id = 2")))) == [(1, None, 2)] * 2


def test_null_coordinates_are_in_no_region(spark):
    points = spark.createDataFrame([(1, None, 2), (2, 3, 4), (3, 5, None)], POINTS)
    q = spark.createDataFrame([(0, 3, 3)], "qid long, q0 long, q1 long")
    box = spark.createDataFrame([(0, -9, -9, 99, 99)], "qid long, lo0 long, lo1 long, hi0 long, hi1 long")
    cells = CellTable(points, 2)
    assert [r.nid for r in cells.knn(q, 3).collect()] == [2] and bag(cells.report_boxes(box)) == [(0, 2, 3, 4)]


def test_reports_are_joined_by_cells_and_held_by_no_task(spark, monkeypatch):
    from quadrille.operators import cells as layout

    rows = [(random.Random(k).randrange(60), random.Random(-k).randrange(60)) for k in range(700)] + [(7, 7)] * 60
    points = made(spark, rows)
    boxes = points.selectExpr("id as qid", "c0 - 9 as lo0", "c1 - 4 as lo1", "c0 + 9 as hi0", "c1 + 4 as hi1")
    balls = workloads.as_queries(points, 2).selectExpr("*", "cast(qid % 20 as bigint) as r")
    wanted = bag(ranges.report_boxes(boxes, points, 2))
    strict = bag(ranges.report_boxes(boxes.selectExpr("qid", "lo0 + 1 as lo0", "lo1 + 1 as lo1", "hi0 - 1 as hi0", "hi1 - 1 as hi1"), points, 2))
    for pairs, part in ((layout.PAIRS_EACH, layout.PART_ROWS), (500, 16)):
        monkeypatch.setattr(layout, "PAIRS_EACH", pairs)
        monkeypatch.setattr(layout, "PART_ROWS", part)
        cells = CellTable(points, 2, levels=4)
        found = cells.report_boxes(boxes)
        assert "FlatMap" not in found._jdf.queryExecution().toString()
        assert bag(found) == wanted
        assert bag(cells.report_boxes(boxes, open_=True)) == strict
        assert bag(CellTable(points, 2, levels=4, rule="rotate").report_boxes(boxes)) == wanted
        assert bag(cells.report_balls(balls)) == bag(ranges.report_balls(balls, points, 2))


def test_counts_in_boxes_take_equal_points_and_equal_boxes_as_one(spark):
    import numpy as np

    from quadrille.operators.celltree import Boxes, weight_in_boxes

    rng = np.random.default_rng(5)
    for dim in (1, 2, 3):
        for n in (1, 63, 400):
            for kind in ("int64", "float64"):
                x, weight = rng.integers(0, 20, (n, dim)).astype(kind), rng.integers(1, 9, n)
                lo = rng.integers(-3, 22, (200, dim)).astype(kind)
                hi = lo + rng.integers(-2, 24, (200, dim)).astype(kind)
                wanted = [weight[((x >= a) & (x <= b)).all(axis=1)].sum() for a, b in zip(lo, hi)]
                assert weight_in_boxes(x, weight, Boxes(lo, hi)).tolist() == wanted
    points = spark.createDataFrame([(k, k % 7, k % 5, k % 3) for k in range(500)], "id long, c0 long, c1 long, c2 long")
    boxes = points.selectExpr("id as qid", "c0 - 1 as lo0", "c0 + 1 as hi0", "c1 as lo1", "c1 + 2 as hi1", "1l as lo2", "c2 as hi2")
    assert bag(CellTable(points, 3, levels=3).count_in_boxes(boxes)) == bag(ranges.count_in_boxes(boxes, points, 3))


def test_counts_after_updates_keep_the_weight_of_copies(spark):
    points = made(spark, [(k % 4, k % 3) for k in range(60)])
    table = updates.SpatialTable(points, 2).insert(points.selectExpr("id + 100 as id", "c0", "c1")).delete(points.where("id < 30"), strict=False)
    boxes = points.selectExpr("id as qid", "c0 as lo0", "c1 as lo1", "c0 + 1 as hi0", "c1 + 1 as hi1")
    found = table.count_in_boxes(boxes)
    assert bag(found) == bag(ranges.count_in_boxes(boxes, table.points, 2))
    assert "weight" in found._jdf.queryExecution().toString()


def test_full_comparison_gives_a_query_its_closest_alone_from_a_task(spark):
    rows = [(random.Random(k).randrange(40), random.Random(-k).randrange(40)) for k in range(300)] + [(3, 3)] * 40
    points, k = made(spark, rows), 12
    for kind in ("long", "double"):
        p = points.selectExpr("id", f"cast(c0 as {kind}) as c0", f"cast(c1 as {kind}) as c1").unionAll(spark.createDataFrame([(999, None, 1)], POINTS).selectExpr("id", f"cast(c0 as {kind})", f"cast(c1 as {kind})"))
        for own in (False, True):
            found = knn.brute_knn(workloads.as_queries(points, 2).selectExpr("qid", f"cast(q0 as {kind}) as q0", f"cast(q1 as {kind}) as q1"), p, k, 2, exclude_self=own)
            wanted = []
            for q, (a, b) in enumerate(rows):
                near = sorted(((c - a) ** 2 + (d - b) ** 2, i) for i, (c, d) in enumerate(rows) if i != q or not own)[:k]
                wanted += [(q, i, d, rk) for rk, (d, i) in enumerate(near, 1)]
            assert bag(found) == sorted(wanted)
            assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_window_searches_by_one_layout_equal_full_ones(spark, monkeypatch):
    from quadrille.operators import replay

    periods = spark.createDataFrame([(2000 + k % 9 if k % 9 != 4 else None, k, random.Random(k).randrange(50), random.Random(-k).randrange(5) * 10) for k in range(400)] + [(2020, 900, 1, 1)], "period int, id long, c0 long, c1 long")
    asking = workloads.as_queries(periods.where("id % 20 = 0"), 2)
    found = replay.window_knn(periods, asking, 4, 2, length=3)
    assert "NestedLoop" not in found._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in found._jdf.queryExecution().toString()
    doubles = periods.selectExpr("period", "id", "c0 / 8 as c0", "c1 / 8 as c1")
    asked = workloads.as_queries(doubles.where("id % 20 = 0"), 2)
    fractions = bag(replay.window_knn(doubles, asked, 4, 2, length=3))
    by_layout = bag(found)
    monkeypatch.setattr(replay, "MOST_APART", 0)
    assert by_layout == bag(replay.window_knn(periods, asking, 4, 2, length=3))
    assert fractions == bag(replay.window_knn(doubles, asked, 4, 2, length=3))


def test_open_boxes_are_split_by_their_widths_and_sent_in_small_parts(spark, monkeypatch):
    from quadrille.operators import cells as layout
    from quadrille.plans import catalog

    rows = [(random.Random(k).randrange(1, 51), 90_000 + 10 * random.Random(-k).randrange(1_000)) for k in range(3_000)]
    points = made(spark, rows)
    boxes = points.where("id % 10 = 0").selectExpr("id as qid", "c0 - 3 as lo0", "c1 - 4000 as lo1", "c0 + 3 as hi0", "c1 + 4000 as hi1")
    strict = bag(ranges.report_boxes(boxes.selectExpr("qid", "lo0 + 1 as lo0", "lo1 + 1 as lo1", "hi0 - 1 as hi0", "hi1 - 1 as hi1"), points, 2))
    asked = []
    dealt = CellTable._dealt
    monkeypatch.setattr(CellTable, "_dealt", lambda self, routed, held: asked.append((self, routed)) or dealt(self, routed, held))
    monkeypatch.setattr(V, "parts", lambda spark, sf: points)
    monkeypatch.setattr(layout, "ROUTED_ROWS", 7, raising=False)
    monkeypatch.setattr(CellTable.__init__, "__defaults__", tuple(16 if d == layout.CELL_ROWS else d for d in CellTable.__init__.__defaults__))
    assert bag(catalog.range_report_open_box(spark, "")) == strict
    (cells, routed), = asked
    sizes = dict(cells.points.groupBy("cell").count().collect())
    assert sum(sizes[r.cell] for r in routed.select("cell").collect()) < 2 * len(strict)


def test_a_cell_gives_all_that_regions_hold_in_small_parts():
    import numpy as np

    from quadrille.operators import celltree
    from quadrille.operators.celltree import BUCKET, Balls, Boxes, Buckets, OpenBoxes

    rng = np.random.default_rng(7)
    for n in (1, 63, 64, 65, 1_500):
        for kind in ("int64", "float64"):
            x, lo = rng.integers(0, 30, (n, 2)).astype(kind), rng.integers(-3, 30, (600, 2)).astype(kind)
            hi, far = lo + rng.integers(-1, 28, (600, 2)).astype(kind), rng.integers(0, 20, 600).astype(kind)
            buckets = Buckets(x)
            assert (buckets.count[:-1] == BUCKET).all() and buckets.count.sum() == n
            for regions, held in (
                (Boxes(lo, hi), lambda q: ((x >= lo[q]) & (x <= hi[q])).all(axis=1)),
                (OpenBoxes(lo, hi), lambda q: ((x > lo[q]) & (x < hi[q])).all(axis=1)),
                (Balls(lo, far), lambda q: ((x - lo[q]) ** 2).sum(axis=1) <= far[q] ** 2),
            ):
                parts = list(buckets.reports(regions))
                assert all(len(r) == len(place) <= celltree.CHUNK * celltree.TILE * BUCKET for r, place in parts)
                assert sorted((r, buckets.order[p]) for rs, ps in parts for r, p in zip(rs.tolist(), ps.tolist())) == [(q, p) for q in range(600) for p in np.flatnonzero(held(q)).tolist()]


@pytest.mark.parametrize("name", ["cell_range_report", "range_report_ball", "range_report_box"])
def test_wide_regions_are_sent_to_few_cells(spark, monkeypatch, name):
    from quadrille.operators import cells as layout
    from quadrille.plans import catalog

    points = made(spark, [(random.Random(k).randrange(1, 51), 90_000 + 10 * random.Random(-k).randrange(1_000)) for k in range(600)])
    boxes = points.selectExpr("id as qid", "c0 - 3 as lo0", "c1 - 4000 as lo1", "c0 + 3 as hi0", "c1 + 4000 as hi1")
    balls = workloads.as_queries(points, 2).selectExpr("*", "3000l as r")
    asked = []
    dealt = CellTable._dealt
    monkeypatch.setattr(CellTable, "_dealt", lambda self, routed, held: asked.append(routed) or dealt(self, routed, held))
    monkeypatch.setattr(V, "parts", lambda spark, sf: points)
    monkeypatch.setattr(CellTable.__init__, "__defaults__", tuple(16 if d == layout.CELL_ROWS else d for d in CellTable.__init__.__defaults__))
    found = getattr(catalog, name)(spark, "")
    assert bag(found) == bag(ranges.report_balls(balls, points, 2) if "ball" in name else ranges.report_boxes(boxes, points, 2))
    assert asked[0].count() <= 2 * 600


def test_runs_are_cut_by_the_widths_of_boxes():
    import numpy as np

    from quadrille.operators.celltree import Balls, Boxes, Buckets

    rng = np.random.default_rng(9)
    x = np.stack([rng.integers(1, 51, 6_000), 90_000 + 10 * rng.integers(0, 1_000, 6_000)], axis=1)
    boxes = Boxes(x[:300] - [3, 4_000], x[:300] + [3, 4_000])
    buckets = Buckets(x, boxes.widths())
    held = [((x >= a) & (x <= b)).all(axis=1) for a, b in zip(boxes.lo, boxes.hi)]
    assert sorted((r, buckets.order[p]) for rs, ps in buckets.reports(boxes) for r, p in zip(rs.tolist(), ps.tolist())) == [(q, p) for q in range(300) for p in np.flatnonzero(held[q]).tolist()]
    compared = sum(int(buckets.count[b].sum()) for _, b, _ in buckets.pairs(boxes, np.arange(300)))
    assert compared < 1.7 * sum(h.sum() for h in held)
    assert Boxes(x, x).widths() is None and Balls(x, x[:, 0]).widths() is None
