"""Readers and writers are inverse; the stream keeps the last five periods."""

import pytest

from quadrille.operators import graphs, knn, workloads
from quadrille.sources import generators, periods, text
from quadrille.streaming import replay
from tests.test_spatial import bag


@pytest.mark.parametrize("files", [1, 3])
def test_points(spark, tmp_path, files):
    points = generators.uniform(spark, 300, 2, -9, 9)
    text.write_points(points, f"{tmp_path}/p", 2, files)
    assert bag(text.read_points(spark, f"{tmp_path}/p", "bigint")) == bag(points)
    assert text.read_points(spark, f"{tmp_path}/p", dims=1).columns == ["id", "c0"]
    real = generators.uniform(spark, 50, 3, whole=False)
    text.write_pbbs_points(real, f"{tmp_path}/q", 3, files)
    assert bag(text.read_pbbs_points(spark, f"{tmp_path}/q")) == bag(real)


def test_hand_written_files(spark, tmp_path):
    (tmp_path / "a.in").write_text("2 3\n1 2 3\n\n 4.5\t5 6 \n")
    assert bag(text.read_points(spark, f"{tmp_path}/a.in")) == [(0, 1.0, 2.0, 3.0), (1, 4.5, 5.0, 6.0)]
    (tmp_path / "g").write_text("WeightedAdjacencyGraph\n3\n3\n0\n2\n2\n1\n2\n0\n0.5\n1.5\n2.5\n")
    assert bag(text.read_graph(spark, f"{tmp_path}/g")) == [(0, 1, 0.5), (0, 2, 1.5), (2, 0, 2.5)]
    (tmp_path / "e").write_text("EdgeArray\n0 5\n2 3\n")
    edges = text.read_edges(spark, f"{tmp_path}/e")
    assert bag(edges) == [(0, 5), (2, 3)] and graphs.vertex_count(edges).first().n == 6
    with pytest.raises(ValueError):
        text.read_sequence(spark, f"{tmp_path}/e")


@pytest.mark.parametrize("header, values", [("sequenceInt", [3, 1, 2]), ("sequenceDouble", [0.5, 2.0]), ("sequenceIntPair", [(1, 2), (3, 4)]), ("sequenceChar", ["a", "b"])])
def test_sequences(spark, tmp_path, header, values):
    kind = text.SEQUENCES[header]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"id long, value {kind}")
    text.write_sequence(rows, f"{tmp_path}/s", header)
    assert bag(text.read_sequence(spark, f"{tmp_path}/s")) == bag(rows)


def test_graphs_and_meshes(spark, tmp_path):
    points = generators.uniform(spark, 60, 2, 0, 99)
    edges = knn.knn_graph(knn.brute_knn(workloads.as_queries(points, 2), points, 3, 2))
    text.write_graph(edges, 60, f"{tmp_path}/g", 2)
    assert bag(text.read_graph(spark, f"{tmp_path}/g", "bigint")) == bag(edges)
    text.write_graph(edges.drop("w"), 60, f"{tmp_path}/u")
    assert bag(text.read_graph(spark, f"{tmp_path}/u")) == bag(edges.drop("w"))
    text.write_edges(edges, f"{tmp_path}/e")
    assert bag(text.read_edges(spark, f"{tmp_path}/e", "bigint")) == bag(edges)
    corners = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "tri long, a long, b long, c long")
    real = generators.uniform(spark, 4, 2, whole=False)
    text.write_triangles(real, corners, f"{tmp_path}/t")
    back, triangles = text.read_triangles(spark, f"{tmp_path}/t")
    assert bag(back) == bag(real) and bag(triangles) == bag(corners)
    assert bag(graphs.triangle_neighbours(triangles)) == [(0, 1, 1), (1, 2, 0)]


def test_generated_files(spark, tmp_path):
    generators.write_files(spark, str(tmp_path), 40, 2, 2, "clustered")
    assert bag(text.read_points(spark, f"{tmp_path}/40_2/2.in", "bigint")) == bag(generators.clustered(spark, 40, 2, seed=2))


def test_positions(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,ts,lon,lat\n1,2014-05-01 00:00:00,1.0,2.0\n1,2014-05-01 00:00:00,1.0,2.0\n2,2013-01-01 00:00:00,1.0,2.0\n3,2015-06-01 00:00:00,3.0,4.0\n")
    rows = periods.read_positions(spark, f"{tmp_path}/p.csv")
    periods.write_periods(rows, f"{tmp_path}/out")
    assert bag(periods.as_periods(spark.read.parquet(f"{tmp_path}/out"), monthly=True)) == [(201405, 1, 1.0, 2.0), (201506, 3, 3.0, 4.0)]


def test_stream_keeps_the_last_periods(spark, tmp_path):
    for k in range(8):
        spark.range(k * 10, k * 10 + k + 1).selectExpr("id", "id as c0").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    query = replay.replay(spark, f"{tmp_path}/in", "id long, c0 long", f"{tmp_path}/live", f"{tmp_path}/check", after=lambda live, number: seen.append((number, live.count(), live.select("batch").distinct().count())))
    query.awaitTermination()
    assert [s[0] for s in seen] == list(range(8)) and [s[2] for s in seen] == [min(5, k + 1) for k in range(8)]
    assert seen[-1][1] == spark.read.parquet(f"{tmp_path}/live").count() and seen[-1][1] == sum(range(4, 9))


def test_event_time_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 05:00:00",), ("2024-01-01 06:00:00",), ("2024-01-02 01:00:00",)], "ts string").selectExpr("cast(ts as timestamp) as ts").write.parquet(f"{tmp_path}/ev")
    counts = replay.period_counts(spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/ev"))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert sorted(r.cnt for r in spark.table("counted").collect()) == [1, 2]
