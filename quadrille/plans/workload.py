"""Runs a workload over a point file, chosen by a bit mask, and times its parts.

    python -m quadrille.plans.workload -p points/1.in -d 2 -t 2 -r 3 -q 1 -k 10

Bits: 0 neighbours, 2 range counts, 3 range reports, 4 and 5 insert and delete fractions,
6 and 7 incremental build and delete, 8 and 9 neighbours after these, 10 balance after
skewed inserts, 11 and 12 a replay of periods by year and by month (files of -y), 13 and 14
single rows against batches, 15 a query cloud far off, 16 all periods as one table, 17
queries of another file (-o). Tag 0 builds, 1 also inserts, 2 also deletes.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import replay, updates, workloads
from quadrille.operators.cells import CellTable
from quadrille.sources.periods import as_periods as periods_of
from quadrille.sources.periods import read_positions
from quadrille.sources.text import read_points

# Shares of the points in a batch, steps of incremental loads, the share of
# points that ask, and the neighbours of the combined periods.
RATIOS = (0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
STEPS = (0.1, 0.2, 0.25, 0.5)
QUERY_SHARE = 0.01
COMBINED_KS = (1, 10)
SINGLES = 10


def _done(frame: DataFrame) -> int:
    return frame.count()


def run(spark: SparkSession, path: str, dim: int, tag: int = 0, rounds: int = 1, mask: int = 0, k: int = 10, other: str | None = None, ratios=RATIOS, steps=STEPS, number: int = 100, years: str | None = None) -> list[dict]:
    """A row (metric, seconds, rows) for each part; seconds are means over the rounds."""
    rows: list[dict] = []
    points = read_points(spark, path, dims=dim)
    more = read_points(spark, other, dims=dim) if other else points
    n = points.count()
    asking = workloads.as_queries(updates.fraction(points, QUERY_SHARE, n), dim)

    def timed(metric: str, make: Callable[[], DataFrame]) -> None:
        spent, count = 0.0, 0
        for _ in range(rounds):
            began = time.perf_counter()
            count = _done(make())
            spent += time.perf_counter() - began
        rows.append({"metric": metric, "seconds": round(spent / rounds, 4), "rows": count})

    timed("build", lambda: CellTable(points, dim).cells)
    if tag >= 1:
        timed("insert", lambda: updates.insert(points, updates.fraction(more, 0.1)))
    if tag >= 2:
        timed("delete", lambda: updates.delete_strict(points, updates.fraction(points, 0.1, n)))
    table = CellTable(points, dim)
    if mask & 1:
        timed("knn", lambda: table.knn(asking, k))
    for bit, name, ask in ((2, "count", table.count_in_boxes), (3, "report", table.report_boxes)):
        for kind in workloads.BRACKETS if mask >> bit & 1 else ():
            boxes = workloads.rectangles(points, dim, kind, number)
            timed(f"range_{name}_{kind}", lambda ask=ask, boxes=boxes: ask(boxes))
    for ratio in ratios:
        if mask >> 4 & 1:
            timed(f"insert_{ratio}", lambda: updates.insert(points, updates.fraction(more, ratio)))
        if mask >> 5 & 1:
            timed(f"delete_{ratio}", lambda: updates.delete_strict(points, updates.fraction(points, ratio, n)))
    for step in steps:
        built = updates.incremental_build(updates.slices(points, step))
        both, gone = updates.insert(points, more), updates.slices(more, step)
        if mask >> 6 & 1:
            timed(f"incremental_build_{step}", lambda: built)
        if mask >> 7 & 1:
            timed(f"incremental_delete_{step}", lambda: updates.incremental_delete(both, gone))
        if mask >> 8 & 1:
            timed(f"knn_after_build_{step}", lambda: CellTable(built, dim).knn(asking, k))
        if mask >> 9 & 1:
            timed(f"knn_after_delete_{step}", lambda: CellTable(updates.incremental_delete(both, gone), dim).knn(asking, k))
    if mask >> 10 & 1:
        timed("balance", lambda: replay.balance(updates.SpatialTable(points, dim), more, (10, 20, 30, 40)))
    for bit, unit in ((11, "year"), (12, "month")) if years else ():
        if mask >> bit & 1:
            periods = periods_of(read_positions(spark, years), monthly=unit == "month")
            asked = workloads.as_queries(periods.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0), 2)
            timed(f"replay_count_{unit}", lambda periods=periods: replay.window_counts(periods))
            timed(f"replay_knn_{unit}", lambda periods=periods, asked=asked: replay.window_knn(periods, asked, k, 2))
    if mask >> 13 & 1:
        timed("insert_singles", lambda: updates.incremental_build([points, *(more.where(F.col("id") == i) for i in range(SINGLES))]))
        timed("insert_batch", lambda: updates.insert(points, more.where(F.col("id") < SINGLES)))
    if mask >> 14 & 1:
        timed("delete_singles", lambda: updates.incremental_delete(points, [points.where(F.col("id") == i) for i in range(SINGLES)]))
        timed("delete_batch", lambda: updates.delete_lenient(points, points.where(F.col("id") < SINGLES)))
    if mask >> 16 & 1 and years:
        every = periods_of(read_positions(spark, years)).drop("period")
        whole = CellTable(every, 2)
        timed("build_combined", lambda: whole.cells)
        for near in COMBINED_KS:
            timed(f"knn_combined_{near}", lambda near=near: whole.knn(workloads.as_queries(every, 2), near))
    if mask >> 15 & 1:
        for widths in (0, 10, 100):
            cloud = workloads.cloud(spark, points, dim, max(1, int(n * QUERY_SHARE)), widths)
            timed(f"knn_far_{widths}", lambda cloud=cloud: table.knn(cloud, k))
    if mask >> 17 & 1:
        timed("knn_foreign", lambda: table.knn(workloads.as_queries(updates.fraction(more, QUERY_SHARE), dim), k))
    return rows


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for flag, name, default in (("-d", "dim", 2), ("-t", "tag", 0), ("-r", "rounds", 1), ("-q", "mask", 1), ("-k", "k", 10), ("-n", "number", 100)):
        parser.add_argument(flag, dest=name, type=int, default=default)
    parser.add_argument("-p", dest="path", required=True)
    parser.add_argument("-o", dest="other")
    parser.add_argument("-y", dest="years")
    parser.add_argument("--line", action="store_true", help="one line of the values in place of a line for each part")
    asked = vars(parser.parse_args())
    line = asked.pop("line")
    rows = run(SparkSession.builder.getOrCreate(), **asked)
    if line:
        print(asked["path"], *[row["seconds"] for row in rows], flush=True)
    else:
        for row in rows:
            print(json.dumps(row))


if __name__ == "__main__":
    main()
