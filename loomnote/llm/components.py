"""Connected components of an edge table, by union-find within tasks and stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnote.llm.shared import Tables

EDGE = "u long, v long"


class UnionFind:
    """Union-find over integers, with path halving; roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges replaced by one edge from each of its nodes to the smallest reachable."""
    sets = UnionFind()
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            sets.union(u, v)
    nodes = np.fromiter(sets.parent, np.int64, len(sets.parent))
    roots = np.fromiter(map(sets.find, nodes.tolist()), np.int64, len(nodes))
    keep = nodes != roots
    nodes, roots = nodes[keep], roots[keep]
    for i in range(0, len(nodes), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65_536]), pa.array(roots[i : i + 65_536])], names=["u", "v"])


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Columns node, component: for every node of an edge (u, v), the smallest it reaches.

    Each round turns the edges of every task into a forest and then hangs every node's
    higher neighbours below its lowest one.  Rounds end when each node has one edge,
    to a node that has none: then the edges are the stars of the components.  The number
    of rounds grows with the logarithm of a component's diameter.
    """
    current = tables.write(edges.select("u", "v").where("u <> v").mapInArrow(_forest, EDGE), f"{name}-0")
    for turn in range(1, 100):
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        hung = both.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionAll(low.select("u", F.col("low").alias("v")))
        following = tables.write(hung.where("u <> v").distinct().mapInArrow(_forest, EDGE).distinct(), f"{name}-{turn}")
        tables.drop(f"{name}-{turn - 1}")
        current = following
        shape = current.groupBy("u").agg(F.count("v").alias("n"))
        several = shape.where("n > 1").limit(1).count()
        if not several and current.join(shape.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
