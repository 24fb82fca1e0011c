"""Watched folders, bursts with a longest wait, and similarity by cells."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from loomnote.operators import graph, history
from loomnote.sources import files
from loomnote.streaming import commits


def put(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def changes(spark, kept, number):
    return {(r.op, r.path, r.new_path, r.text) for r in spark.read.parquet(f"{kept}/changes/look={number}").collect()}


def test_looks_find_added_edited_renamed_and_deleted_files(spark, tmp_path):
    root, kept = tmp_path / "v", str(tmp_path / "kept")
    for name, text in (("a.md", "one"), ("d/b.md", "two"), ("c.md", "three"), (".git/x.md", "no"), ("p.png", "no")):
        put(root / name, text, 1000)
    files.look(spark, str(root), kept, 0)
    assert changes(spark, kept, 0) == {("add", "a.md", None, "one"), ("add", "d/b.md", None, "two"), ("add", "c.md", None, "three")}
    put(root / "a.md", "ONE", 2000)
    (root / "d/b.md").rename(root / "z.md")
    (root / "c.md").unlink()
    put(root / "new.md", "four", 2000)
    for _ in range(2):  # a look that is repeated
        files.look(spark, str(root), kept, 1)
    assert changes(spark, kept, 1) == {("modify", "a.md", None, "ONE"), ("rename", "d/b.md", "z.md", "two"), ("delete", "c.md", None, None), ("add", "new.md", None, "four")}
    files.look(spark, str(root), kept, 2)
    assert changes(spark, kept, 2) == set()
    every = spark.read.schema(files.SEEN).option("recursiveFileLookup", True).parquet(f"{kept}/changes")
    assert {r.path for r in commits.upsert(every, None).where("not gone").collect()} == {"a.md", "z.md", "new.md"}
    listed = spark.read.parquet(f"{kept}/listing/2")
    touched = files.listing(spark, str(root), listed.withColumn("revision", F.lit("kept")))
    assert {r.revision for r in touched.collect()} == {"kept"}  # nothing was read again


def test_a_watch_feeds_the_change_stream(spark, tmp_path):
    root, kept = tmp_path / "v", str(tmp_path / "kept")
    put(root / "a.md", "one", 1000)
    run = files.watch_folder(spark, str(root), kept, str(tmp_path / "w")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            run.awaitTermination(0.5)
            if os.path.isdir(f"{kept}/changes/look=1"):
                break
    finally:
        run.stop()
    assert changes(spark, kept, 0) == {("add", "a.md", None, "one")}
    stream = commits.change_stream(spark, f"{kept}/changes")
    state = commits.maintain(stream, str(tmp_path / "state"), str(tmp_path / "c")).trigger(availableNow=True).start()
    state.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "state").iterdir() if p.name.isdigit())
    assert [r.path for r in spark.read.parquet(str(tmp_path / "state" / str(last))).where("not gone").collect()] == ["a.md"]


def test_bursts_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rnd = random.Random(4)
    schema, rows, at = "key string, seq long, epoch double", [], 1000.0
    for seq in range(120):
        at += rnd.choice([0.05, 0.1, 0.2, 0.4, 0.4, 3.0])
        rows.append((rnd.choice("ab"), seq, at))
    rows.append(("end", 1000, at + 100))
    for i in range(0, len(rows), 25):
        spark.createDataFrame(rows[i : i + 25], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = commits.coalesced(stream, 0.5, 2.0).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    want = history.coalesced(spark.createDataFrame(rows, schema), 0.5, 2.0).where("key <> 'end'").collect()
    told = lambda rs: sorted((r.key, round(r.first, 6), round(r.last, 6), r.changes, round(r.fires, 6)) for r in rs)
    assert told(spark.table("bursts").where("key <> 'end'").collect()) == told(want)
    assert any(r.fires < r.last + 0.5 for r in want) and any(r.changes > 3 for r in want)


def test_similar_by_cells_is_exact_and_compares_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 25)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.15 * rng.normal(size=(60, 16)) for c in centres] + [rng.normal(size=(40, 16)), np.zeros((2, 16))])
    rows = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in rng.permutation(len(x))], "id long, vec array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 9)
    want = set()
    for i in range(len(x)):
        near = sorted((j for j in range(len(x)) if j != i and s[i, j] >= 0.75), key=lambda j: (-s[i, j], j))[:6]
        want |= {(i, j) for j in near}
    assert {(r.a, r.b) for r in graph.similar(rows).collect()} == want
    packed, pairs = graph._cells(rows, len(x), 0.75)
    met = graph.meetings(packed, pairs).agg(F.sum(F.size("left") * F.size("right"))).first()[0]
    assert met < 0.4 * len(x) * len(x) / 2
    assert graph.similar(rows.limit(0)).count() == 0
