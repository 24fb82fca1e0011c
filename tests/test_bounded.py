"""What a task or the driver holds does not grow with the input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomnote.operators import history, markdown, scoring


def test_notes_are_parsed_in_parcels(spark):
    texts = ["x" * 400_000, None, "", "y" * 3_000_000, *["z" * 1000] * 3000]
    batch = pa.record_batch({"path": [str(i) for i in range(len(texts))], "text": texts})
    parts = list(markdown.parcels(batch))
    assert [p for part in parts for p in part.column("path").to_pylist()] == batch.column("path").to_pylist()
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= markdown.PARCEL for p in parts) and len(parts) > 4
    rows = spark.createDataFrame([("a/b.md", None), (None, "---\ntitle: T\ncreated: 5\ntags: [x]\n---\n# H\nbody"), ("c.md", "")], "path string, text string")
    got = {r.path: (r.title, r.tags, r.created, len(r.chunks)) for r in markdown.parse_notes(rows).collect()}
    assert got == {"a/b.md": ("b", [], None, 0), None: ("T", ["x"], 5, 1), "c.md": ("c", [], None, 0)}


def test_ancestors_do_not_send_the_parents_to_the_driver(spark, monkeypatch):
    parents = spark.range(1, 4000).select(F.concat(F.lit("c"), "id").alias("commit"), F.when(F.col("id") > 1, F.concat(F.lit("c"), F.floor(F.col("id") / 2).cast("string"))).alias("parent"))
    want = {f"c{3999 >> i}" for i in range(12)}
    found = history.ancestors(parents, "c3999")
    assert {r.commit for r in found.collect()} == want
    plans = []
    monkeypatch.setattr(history, "cut", lambda rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), rows.checkpoint())[1])
    history.ancestors(parents, "c3999")
    assert all("BuildRight" in p and "BuildLeft" not in p for p in plans[1:])
    monkeypatch.setattr(history, "FEW", 0)
    assert {r.commit for r in history.ancestors(parents, "c3999").collect()} == want and "Broadcast" not in plans[-1]


def test_best_holds_few_rows():
    best = scoring.Best(2)
    for i in range(40):
        best.add(np.zeros(10_000, np.int64), np.array([f"{i}-{j}" for j in range(10_000)]), np.arange(10_000) + i * 1e-3)
        assert best.size <= 110_000
    assert best.kept()[1].tolist() == ["39-9999", "38-9999"]
