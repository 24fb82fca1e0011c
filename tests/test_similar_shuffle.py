"""Similar vectors are found without shuffling pairs of blocks."""

import numpy as np

from loomnote.operators import graph


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 10)
    x = np.random.default_rng(4).normal(size=(200, 8))
    rows = spark.createDataFrame([(f"n{i}", [float(v) for v in x[i]]) for i in range(200)], "id string, vec array<double>")
    found = graph.similar(rows, k=4, threshold=0.1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(f"n{i}", f"n{j}", s[i, j]) for i in range(200) for j in sorted((j for j in range(200) if j != i and s[i, j] >= 0.1), key=lambda j: (-s[i, j], f"n{j}"))[:4]}
    assert {(r.a, r.b, r.score) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "left#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_ids_that_stand_for_several_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])], "id long, vec array<double>")
    assert sorted((r.a, r.b) for r in graph.similar(rows, k=3, threshold=0.9).collect()) == [(1, 2), (1, 3), (2, 1), (3, 1)]
