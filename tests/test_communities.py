"""Communities of large graphs without a task that holds one; attachment over passes; progress of a stream."""

import time

from pyspark.sql import functions as F

from loomnote.operators import graph
from loomnote.streaming import commits

EDGE = "a string, b string, weight double"


def cliques(n, size):
    edges = [(f"{c}-{i}", f"{c}-{j}", 1.0) for c in range(n) for i in range(size) for j in range(i)]
    return edges + [(f"{c}-0", f"{(c + 1) % n}-1", 1.0) for c in range(n)]


def test_synchronous_moves_are_as_good_as_sequential_ones(spark):
    edges = cliques(6, 5)
    frame = spark.createDataFrame(edges, EDGE).repartition(3)
    nodes = sorted({x for e in edges for x in e[:2]})
    last = graph.louvain(nodes, edges)[-1]
    plain = spark.createDataFrame([(n, str(c)) for n, c in last.items()], "node string, community string")
    want = graph.modularity(plain, frame).first()[0]
    found = graph.parallel_louvain(frame, 10)
    top = found.groupBy("node").agg(F.max_by("community", "level").alias("community"))
    assert top.count() == len(nodes) and graph.modularity(top, frame).first()[0] >= 0.99 * want
    assert found.where("community > node").count() == 0


def test_a_large_component_is_not_one_tasks(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(graph, "parallel_louvain", lambda edges: taken.append(edges.count()) or edges.select(F.lit(0).cast("long").alias("level"), F.lit("x").alias("community"), F.col("a").alias("node")))
    frame = spark.createDataFrame(cliques(1, 6) + [("u", "v", 1.0)], EDGE)
    found = graph.communities(spark.createDataFrame([("lone",)], "node string"), frame, large=10)
    assert taken == [16] and {(r.community, r.node) for r in found.where("node in ('u', 'v', 'lone')").collect()} == {("u", "u"), ("u", "v"), ("lone", "lone")}


def test_notes_wait_until_a_neighbour_is_placed(spark, tmp_path):
    placed = spark.createDataFrame([("p1", [1.0, 0.0], "c1"), ("p2", [-1.0, 0.0], "c2")], "id string, vec array<double>, community string")
    batch = lambda *rows: spark.createDataFrame(rows, "id string, vec array<double>")
    told = lambda frame: {(r.node, r.community, r.since) for r in frame.collect()}
    folder = str(tmp_path / "attach")
    assert told(commits.attach_pending(spark, folder, 0, batch(("a", [0.4, 1.0]), ("b", [1.0, 0.1])), placed)) == {("a", None, None), ("b", "c1", 1)}
    for _ in range(2):  # a pass that runs twice
        got = told(commits.attach_pending(spark, folder, 1, batch(("m", [0.9, 0.8]), ("b", [9.0, 9.0])), placed))
        assert got == {("a", None, None), ("b", "c1", 2), ("m", "c1", 2)}
    assert told(commits.attach_pending(spark, folder, 2, batch(), placed)) == {("a", "c1", 3), ("b", "c1", 3), ("m", "c1", 3)}
    assert told(commits.attach_pending(spark, str(tmp_path / "few"), 0, batch(("x", [1.0, 0.0]), ("y", [1.0, 0.0])), placed, most=1)) == {("x", "c1", 1), ("y", None, None)}


def test_progress_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    watch = commits.Progress("counted", 30)
    spark.streams.addListener(watch)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = stream.writeStream.format("noop").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        for _ in range(100):
            if watch.ended:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    now = watch.now()
    assert (now["done"], now["total"], now["ended"], now["left"]) == (30, 30, True, 0.0) and now["rate"] > 0
