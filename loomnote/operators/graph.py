"""The note graph: similarity and link edges, communities, centroids, titles, attachment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomnote.functions import text as T
from loomnote.operators.order import cut, numbered

#: Neighbours a note, similarity threshold, link weight, Louvain's limits.
NEIGHBOURS, THRESHOLD, LINK_WEIGHT = 6, 0.75, 1.5
SWEEPS, LEVELS, EPSILON = 50, 20, 1e-12
BLOCK, MOST_CENTRES = 1024, 128
#: Edges of a component that one task may have; rounds of synchronous moves a level.
LARGE, ROUNDS = 2_000_000, 30


def _cells(rows: DataFrame, count: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Packed blocks (cell, part, rows) and the pairs of cells (x, y, x <= y) that may hold similar vectors.

    Centres are at most MOST_CENTRES vectors of lowest hash.  A cell is what is nearest to one
    centre, in one band of angles to it.  On the sphere angles obey the triangle inequality:
    vectors of two cells are at least as far apart as the centres, less both cells' largest
    angles, and at least as far as one's smallest angle, less the rest; cells for which that
    is more than the threshold's angle need not meet.  The bound is exact; the driver has the
    centres and two angles a cell.
    """
    wanted = min(MOST_CENTRES, max(1, 2 * count // BLOCK))
    some = rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow().column("vec").to_pylist()

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    centres = unit(np.array(some, np.float64).reshape(len(some), -1))
    held = rows.sparkSession.sparkContext.broadcast(centres)
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6  # scores are rounded
    width = max(reach, 0.1) / 2
    bands = int(np.pi / width) + 1

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            cosine = unit(np.asarray(lists.flatten(), np.float64).reshape(len(batch), -1)) @ held.value.T
            cell = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(batch)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((cell * bands + (angle / width).astype(np.int64)).astype(np.int32)), pa.array(angle)], names=["id", "vec", "cell", "angle"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = cut(rows.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(nearest, f"id {kind}, vec array<double>, cell int, angle double"))
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).orderBy("cell").toArrow()
    cell, n, least, most = (np.asarray(c.combine_chunks()) for c in cells.columns)
    apart = np.arccos(np.clip(centres @ centres.T, -1, 1))[np.ix_(cell // bands, cell // bands)]
    far = np.maximum(apart - most[:, None] - most[None], np.maximum(least[:, None] - most[None], least[None] - most[:, None]) - apart)
    x, y = np.nonzero(np.triu(far <= reach))
    spark = rows.sparkSession
    parts = F.broadcast(spark.createDataFrame(pa.table({"cell": cell, "parts": -(-n // BLOCK)})))
    row = F.struct("id", "vec").alias("row")
    packed = dealt.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").alias("part"), row).groupBy("cell", "part").agg(F.collect_list("row").alias("rows"))
    return packed, spark.createDataFrame(pa.table({"x": cell[x], "y": cell[y]}))


def meetings(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """x, y, left, right: every two blocks of cells that may hold similar vectors, once; x = y: a block with itself."""
    number = (F.col("cell").cast("long") * (1 << 32) + F.col("part")).alias("x")
    one = packed.select(F.col("cell").alias("cx"), number, F.col("rows").alias("left"))
    two = packed.select(F.col("cell").alias("cy"), number.alias("y"), F.col("rows").alias("right"))
    met = one.join(F.broadcast(pairs.toDF("cx", "cy")), "cx").join(two, "cy").where("cx < cy or x <= y")
    return met.select("x", "y", "left", "right")


def similar(vectors: DataFrame, k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, score: each vector's k most similar others of at least the threshold (ties: smaller b).

    vectors: id, vec, all of one length.  Rows are packed into blocks by cell.  A block's
    task reads the blocks of all cells that may hold similar vectors, one matrix product
    each, and keeps k rows an id all along: what is shuffled grows with the vectors, not
    with the pairs of blocks.
    """
    rows = vectors.where("vec is not null")
    count = rows.count()
    if not count:
        kind = vectors.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, score double")
    packed, pairs = _cells(rows, count, threshold)
    packed = cut(packed)
    repeated = rows.select("id").distinct().count() < count
    kind = vectors.schema["id"].dataType.simpleString()

    def unit(side: pa.StructArray) -> np.ndarray:
        x = np.asarray(side.field("vec").flatten(), dtype=np.float64).reshape(len(side), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # ids, vectors, the least score that still counts
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # row, name, score
        for batch in batches:
            for x, y, one, two in zip(*batch.columns, strict=True):
                if (key := x.as_py()) not in blocks:
                    blocks[key] = np.array(one.values.field("id").to_pylist()), unit(one.values), np.full(len(one), float(threshold))
                a, left, least = blocks[key]
                score = left @ unit(two.values).T
                i, j = np.nonzero(score >= least[:, None] - 1e-8)  # to be rounded
                near = np.round(score[i, j], 9)
                i, j, near = i[near >= least[i]], j[near >= least[i]], near[near >= least[i]]
                if not len(i):
                    continue
                name = np.array(two.values.field("id").take(pa.array(j)).to_pylist())
                if x == y or repeated:  # an id lies in one block, unless it stands for several vectors
                    other = a[i] != name
                    i, name, near = i[other], name[other], near[other]
                row, found = i, near
                if key in kept:
                    row, name, found = (np.concatenate(z) for z in zip(kept[key], (row, name, found), strict=True))
                order = np.lexsort((name, -found, row))
                row, name, found = row[order], name[order], found[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                least[row[place == k - 1]] = found[place == k - 1]
                kept[key] = row[place < k], name[place < k], found[place < k]
        for key, (row, name, found) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(blocks[key][0][row].tolist(), one_kind), pa.array(name.tolist(), one_kind), pa.array(found)], names=["a", "b", "score"])

    one_kind = to_arrow_type(vectors.schema["id"].dataType)
    found = _streamed(packed, pairs).mapInArrow(best, f"a {kind}, b {kind}, score double")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("a", "b", "score")


def _streamed(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """x, y, left, right: each block with every block of a cell that may hold similar vectors, both ways.

    A Cartesian product of the written blocks: tasks read the blocks from the shared folder,
    nothing is shuffled, and all that one block meets comes to one task.
    """
    parts = packed.rdd.getNumPartitions()
    number = F.col("cell").cast("long") * (1 << 32) + F.col("part")
    both = pairs.toDF("x", "y")
    both = both.unionAll(both.select("y", "x")).groupBy(F.col("x").alias("cell")).agg(F.collect_set("y").alias("near"))  # a row a cell
    one = packed.join(F.broadcast(both), "cell").select(number.alias("x"), F.col("rows").alias("left"), "near")
    two = packed.select(number.alias("y"), F.col("rows").alias("right"), F.col("cell").alias("other"))
    met = one.hint("shuffle_replicate_nl").join(two, F.array_contains("near", F.col("other")))
    return met.select("x", "y", "left", "right").coalesce(parts)


def canonical(edges: DataFrame) -> DataFrame:
    """a < b, kind, weight: loops dropped, LINK before SIM, then the largest weight.  edges: a, b, kind, weight."""
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", "weight")
    return ends.groupBy("a", "b").agg(F.max_by(F.struct("kind", "weight"), F.struct(F.col("kind") == "LINK", "weight")).alias("e")).select("a", "b", "e.kind", "e.weight")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, edges: weighted degree over both directions of canonical edges."""
    both = edges.select(F.col("a").alias("node"), "weight").unionAll(edges.select(F.col("b").alias("node"), "weight"))
    return both.groupBy("node").agg(F.round(F.sum("weight"), 6).alias("degree"), F.count("*").alias("edges"))


def louvain(nodes: list, edges: list[tuple]) -> list[dict]:
    """Levels of a deterministic Louvain: each maps a node to its community's number.

    Nodes are visited in index order.  A node goes where `weight to it - total * degree /
    2m` is largest; within EPSILON the lowest number wins, even over its own.
    """
    index = {n: i for i, n in enumerate(sorted(nodes))}
    near: list[dict[int, float]] = [{} for _ in index]
    for a, b, w in edges:
        i, j = index[a], index[b]
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    loops = [0.0] * len(near)
    home = list(range(len(near)))
    levels: list[dict] = []
    for _ in range(LEVELS):
        degree = [sum(ws.values()) + 2 * loops[i] for i, ws in enumerate(near)]
        total = sum(degree)
        if not total:
            break
        own = list(range(len(near)))
        mass = degree[:]
        for _ in range(SWEEPS):
            moved = False
            for i, ws in enumerate(near):
                to: dict[int, float] = {own[i]: 0.0}
                for j, w in ws.items():
                    to[own[j]] = to.get(own[j], 0.0) + w
                mass[own[i]] -= degree[i]
                best, gain = own[i], None
                for c in sorted(to):
                    g = to[c] - mass[c] * degree[i] / total
                    if gain is None or g > gain + EPSILON:
                        best, gain = c, g
                mass[best] += degree[i]
                moved |= best != own[i]
                own[i] = best
            if not moved:
                break
        names = {c: k for k, c in enumerate(sorted(set(own)))}
        if len(names) == len(near):
            break
        own = [names[c] for c in own]
        home = [own[h] for h in home]
        levels.append({n: home[i] for n, i in index.items()})
        joined: list[dict[int, float]] = [{} for _ in names]
        inner = [0.0] * len(names)
        for i, ws in enumerate(near):
            inner[own[i]] += loops[i]
            for j, w in ws.items():
                if own[i] == own[j]:
                    inner[own[i]] += w / 2
                else:
                    joined[own[i]][own[j]] = joined[own[i]].get(own[j], 0.0) + w
        near, loops = joined, inner
    return levels or [{n: i for n, i in index.items()}]


def local_moving(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, own: communities of one graph (a, b, weight; a = b: a loop) by synchronous moves, spread over tasks.

    Each round a part of the nodes, another half by hash each time and in the end ever fewer,
    goes where `weight to it - total * degree / 2m` is largest, if that beats staying by
    EPSILON; of equal ones to the smallest.  Since the rest stays, two nodes seldom change
    places for ever.  A round is a join with the neighbours' communities and two aggregates;
    no node's neighbours are gathered.
    """
    both = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionAll(edges.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"), "weight"))
    both = cut(both.groupBy("u", "v").agg(F.sum("weight").alias("weight")))
    ends = both.select(F.col("u").alias("node"), "weight").unionAll(edges.where("a = b").select(F.col("a").alias("node"), F.col("weight") * 2))
    degree = cut(ends.groupBy("node").agg(F.sum("weight").alias("degree")))
    total = degree.agg(F.sum("degree")).first()[0]
    now = cut(degree.select("node", F.col("node").alias("own"), "degree"))
    quiet = 0
    for turn in range(rounds):
        share = 2 if turn < rounds // 2 else 4  # fewer at a time, once most have found their place
        chosen = F.pmod(F.xxhash64(F.col("node").cast("string"), F.lit(turn)), F.lit(share)) == 0
        mass = now.groupBy("own").agg(F.sum("degree").alias("mass"))
        asked = now.where(chosen)
        near = both.join(asked.select(F.col("node").alias("u")), "u").join(now.select(F.col("node").alias("v"), F.col("own").alias("to")), "v")
        to = near.groupBy("u", "to").agg(F.sum("weight").alias("weight")).withColumnRenamed("u", "node")
        stay = asked.select("node", F.col("own").alias("to"), F.lit(0.0).alias("weight"))
        offers = to.unionAll(stay).groupBy("node", "to").agg(F.sum("weight").alias("weight")).join(asked, "node").join(mass.withColumnRenamed("own", "to"), "to")
        less = F.when(F.col("to") == F.col("own"), F.col("degree")).otherwise(0.0)
        gain = F.col("weight") - (F.col("mass") - less) * F.col("degree") / F.lit(total)
        ranked = offers.select("node", "own", "to", gain.alias("gain"))
        best = ranked.groupBy("node").agg(F.min_by("to", F.struct(-F.round("gain", 12), "to")).alias("to"), F.max("gain").alias("most"), F.max(F.when(F.col("to") == F.col("own"), F.col("gain"))).alias("here"))
        moves = cut(best.where(F.col("most") > F.col("here") + EPSILON).select("node", "to"))
        moved = moves.count()
        quiet = 0 if moved else quiet + 1
        if moved:
            now = cut(now.join(moves, "node", "left").select("node", F.coalesce("to", "own").alias("own"), "degree"))
        elif quiet >= share:
            break
    return now.select("node", "own")


def parallel_louvain(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """level, community (its smallest node), node: the hierarchy of one large graph, no part of it in one task.

    Between levels each community becomes a node, by aggregates, until nothing joins.
    """
    current, home, out = edges.select("a", "b", "weight"), None, None
    for level in range(LEVELS):
        found = local_moving(current, rounds)
        names = found.groupBy("own").agg(F.min("node").alias("community"))
        found = cut(found.join(names, "own").select("node", "community"))
        if found.where("node <> community").isEmpty():
            break
        home = found if home is None else home.join(found.select(F.col("node").alias("held"), F.col("community").alias("next")), F.col("community") == F.col("held")).select("node", F.col("next").alias("community"))
        home = cut(home)
        rows = home.select(F.lit(level).cast("long").alias("level"), "community", "node")
        out = rows if out is None else out.unionAll(rows)
        joined = current.join(found.toDF("a", "ca"), "a").join(found.toDF("b", "cb"), "b")
        current = cut(joined.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")))
    if out is None:
        nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))).distinct()
        out = nodes.select(F.lit(0).cast("long").alias("level"), F.col("node").alias("community"), "node")
    return out


def modularity(homes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the modularity of node, community over edges (a, b, weight) without loops."""
    total = 2 * edges.agg(F.sum("weight")).first()[0]
    ends = edges.select(F.col("a").alias("node"), "weight").unionAll(edges.select(F.col("b").alias("node"), "weight"))
    mass = ends.join(homes, "node").groupBy("community").agg(F.sum("weight").alias("mass"))
    inner = edges.join(homes.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(homes.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb")
    spread = mass.agg(F.sum(F.pow(F.col("mass") / total, 2)).alias("spread"))
    return inner.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inner")).crossJoin(spread).select((2 * F.col("inner") / total - F.col("spread")).alias("modularity"))  # one row each


def communities(nodes: DataFrame, edges: DataFrame, detect=louvain, large: int = LARGE) -> DataFrame:
    """level, community, node: the Louvain hierarchy, one independent run a connected part.

    `detect` may be another detector with louvain's signature.  Louvain is sequential, but
    its moves never join nodes without a path between them, so each connected component is a
    group of its own and the groups run in parallel.  A component of more than `large` edges
    is not one task's: `parallel_louvain` takes it.
    """
    edges = cut(edges)  # read several times
    parts = cut(components(edges.select("a", "b")))
    lone = nodes.select("node").join(parts.select("node"), "node", "left_anti")
    mine = edges.join(parts.select(F.col("node").alias("a"), "part"), "a").select("part", "a", "b", "weight")
    giants = [r.part for r in mine.groupBy("part").agg(F.count("a").alias("n")).where(F.col("n") > large).select("part").collect()]  # all edges / large at most

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(group["a"]) | set(group["b"]))
        found = detect(names, sorted(zip(group["a"], group["b"], group["weight"], strict=True)))
        rows = [(level, n, c) for level, homes in enumerate(found) for n, c in homes.items()]
        frame = pd.DataFrame(rows, columns=["level", "node", "number"])
        frame["community"] = frame.groupby(["level", "number"])["node"].transform("min")
        return frame[["level", "community", "node"]]

    kind = nodes.schema["node"].dataType.simpleString()
    small = mine.where(~F.col("part").isin(giants)) if giants else mine
    out = small.groupBy("part").applyInPandas(run, f"level long, community {kind}, node {kind}")
    for part in giants:
        out = out.unionAll(parallel_louvain(mine.where(F.col("part") == F.lit(part))))
    return out.unionAll(lone.select(F.lit(0).cast("long").alias("level"), F.col("node").alias("community"), "node"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, part: the smallest node that each node reaches, by hanging neighbours lower each round."""
    current = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
    for _ in range(rounds):
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        hung = both.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionAll(low.select("u", F.col("low").alias("v")))
        current = cut(hung.where("u <> v").distinct())
        shape = current.groupBy("u").agg(F.count("v").alias("n"), F.min("v").alias("v"))
        if shape.where("n > 1").isEmpty() and current.join(shape.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("part")).unionAll(roots)


def centroids(members: DataFrame) -> DataFrame:
    """community, size, vec: mean of member vectors (community, vec), length one."""
    each = members.select("community", F.posexplode("vec").alias("i", "x")).groupBy("community", "i").agg(F.avg("x").alias("m"))
    means = each.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("parts")).select("community", F.transform("parts", lambda p: p["m"]).alias("mean"))
    norm = F.sqrt(T.dot(F.col("mean"), F.col("mean")))
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    return means.withColumn("norm", norm).where("norm > 0").join(sizes, "community").select("community", "size", F.transform("mean", lambda x: x / F.col("norm")).alias("vec"))


def list_communities(hierarchy: DataFrame, level: int = 0) -> DataFrame:
    """community, size, place: a level's communities (level, community, node), the largest first.

    A level above the last one is the last one.
    """
    top = hierarchy.agg(F.max("level")).first()[0] or 0
    rows = hierarchy.where(F.col("level") == min(max(level, 0), top)).groupBy("community").agg(F.count("*").alias("size"))
    return numbered(rows, "place", F.desc("size"), "community").withColumn("place", F.col("place") + 1)


def rank_communities(centres: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, community, score, rank: communities by the cosine of their centroid."""
    pairs = queries.select("query_id", F.col("vec").alias("q")).crossJoin(centres.select("community", "vec"))
    scored = pairs.select("query_id", "community", F.round(T.cosine(F.col("vec"), F.col("q")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "community")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def titles(members: DataFrame) -> DataFrame:
    """community, title: the deepest folder that holds at least half of the members (community, path).

    Ties go to the fuller, then the smaller folder.  Without one: the fullest direct
    folder, and without folders the first basename.
    """
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    rows = members.withColumn("folders", F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>")))
    sizes = rows.groupBy("community").agg(F.count("*").alias("n"), F.min(T.stem(F.col("path"))).alias("name"))
    counts = rows.select("community", F.explode("folders").alias("folder")).groupBy("community", "folder").agg(F.count("*").alias("c"))
    half = counts.join(sizes, "community").where(F.col("c") >= F.ceil(F.col("n") / 2))
    order = Window.partitionBy("community").orderBy(F.desc(F.size(F.split("folder", "/"))), F.desc("c"), "folder")
    best = half.withColumn("turn", F.row_number().over(order)).where("turn = 1").select("community", F.col("folder").alias("by_half"))
    direct = rows.where(F.size("folders") > 0).select("community", F.element_at("folders", -1).alias("folder")).groupBy("community", "folder").agg(F.count("*").alias("c"))
    fullest = direct.withColumn("turn", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("c"), "folder"))).where("turn = 1").select("community", F.col("folder").alias("by_most"))
    return sizes.join(best, "community", "left").join(fullest, "community", "left").select("community", F.coalesce("by_half", "by_most", "name").alias("title"))


def unique_titles(named: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Titles that several communities share get their community in brackets.

    With members (community, path) such titles are extended first, by the two most common
    path segments that follow at their depth; only those still shared get the brackets.
    """
    if members is not None:
        named = _extended(named, members)
    shared = named.groupBy("title").agg(F.count("*").alias("n")).where("n > 1").select("title", F.lit(True).alias("shared"))
    return named.join(shared, "title", "left").select("community", F.when(F.col("shared"), F.concat("title", F.lit(" ("), F.col("community").cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("title"))


def _extended(named: DataFrame, members: DataFrame) -> DataFrame:
    shared = named.groupBy("title").agg(F.count("*").alias("n")).where("n > 1").select("title")
    depth = F.size(F.split("title", "/"))
    rows = members.join(named.join(shared, "title", "left_semi"), "community").withColumn("segment", F.get(F.split("path", "/"), depth))
    counts = rows.where("segment is not null").withColumn("segment", F.regexp_replace("segment", r"\.md\z", "")).groupBy("community", "segment").agg(F.count("*").alias("c"))
    order = Window.partitionBy("community").orderBy(F.desc("c"), "segment")
    top = counts.withColumn("turn", F.row_number().over(order)).where("turn <= 2")
    more = top.groupBy("community").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "segment")))["segment"], ", ").alias("more"))
    title = F.coalesce(F.concat("title", F.lit("/"), "more", F.lit("…")), F.col("title"))
    return named.join(more, "community", "left").select("community", title.alias("title"))


def vote(neighbours: DataFrame, placed: DataFrame) -> DataFrame:
    """node, community, weight: where a node's neighbours (a, b, score) mostly are; ties: smallest."""
    sums = neighbours.join(placed.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.round(F.sum("score"), 6).alias("weight"))
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "community")
    return sums.withColumn("turn", F.row_number().over(order)).where("turn = 1").select("node", "community", "weight")


def drift(voted: DataFrame, homes: DataFrame, sample: int = 50) -> DataFrame:
    """sampled, moved, ratio: of at most `sample` evenly spaced attached nodes, those voted elsewhere."""
    total = homes.count()
    step = max(1, -(-total // sample))
    picked = numbered(homes.select("node", "community"), "turn", "node").where(F.col("turn") % step == 0).select("node", F.col("community").alias("home"))
    judged = picked.join(voted.select("node", "community"), "node", "left")
    moved = F.coalesce(F.col("community") != F.col("home"), F.lit(False))
    return judged.agg(F.count("*").alias("sampled"), F.count_if(moved).alias("moved"), F.round(F.avg(moved.cast("double")), 6).alias("ratio"))


def rebuild_due(status: DataFrame, threshold: int, interval: int) -> DataFrame:
    """vault, due: graphs never built, with enough attached notes, or old enough."""
    due = F.col("built_at").isNull() | (F.col("attached") >= threshold) | (F.col("now") - F.col("built_at") >= interval)
    return status.select("vault", due.alias("due"))


def status(nodes: DataFrame, edges: DataFrame, members: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: counts of nodes, edges by kind, communities, and the share of notes with a vector."""
    a = nodes.agg(F.count("*").alias("nodes"))
    b = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "LINK").alias("links"), F.count_if(F.col("kind") == "SIM").alias("similar"))
    c = members.agg(F.count_distinct("community").alias("communities"))
    d = nodes.join(vectors.select(F.col("id").alias("node")).distinct(), "node", "left_semi").agg(F.count("*").alias("with_vector"))
    joined = a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each
    return joined.withColumn("coverage", F.round(F.col("with_vector") / F.greatest("nodes", F.lit(1)), 6))


def parents(children: DataFrame, upper: DataFrame) -> DataFrame:
    """child, parent: communities whose members (community, node) all lie in one upper community."""
    joined = children.select("node", F.col("community").alias("child")).join(upper.select("node", F.col("community").alias("parent")), "node", "left")
    sums = joined.groupBy("child").agg(F.count_distinct(F.coalesce(F.col("parent").cast("string"), F.lit(""))).alias("n"), F.min("parent").alias("parent"), F.count_if(F.col("parent").isNull()).alias("outside"))
    return sums.where("n = 1 and outside = 0").select("child", "parent")


#: What a summary's prompt may hold, and the smallest community that gets one.
PROMPT_CHARS, NOTE_CHARS, CHILD_CHARS, SMALLEST = 12_000, 1_500, 600, 3


def summary_prompts(members: DataFrame) -> DataFrame:
    """community, notes, sampled, prompt: the texts to summarise (members: community, path, text).

    Notes come by path, cut to NOTE_CHARS each, as long as PROMPT_CHARS are not exceeded;
    `sampled` says that some were left out.
    """
    piece = F.concat(F.lit("## "), "path", F.lit("\n"), F.substring("text", 1, NOTE_CHARS), F.lit("\n"))
    order = Window.partitionBy("community").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    rows = members.withColumn("piece", piece).withColumn("until", F.sum(F.length("piece")).over(order))
    kept = F.when(F.col("until") <= PROMPT_CHARS, F.struct("path", "piece"))
    out = rows.groupBy("community").agg(F.count("*").alias("notes"), F.array_sort(F.collect_list(kept)).alias("parts")).where(F.col("notes") >= SMALLEST)
    return out.select("community", "notes", (F.size("parts") < F.col("notes")).alias("sampled"), F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("prompt"))


def child_prompts(children: DataFrame) -> DataFrame:
    """community, children, included, covered, prompt: what to summarise of a community, from its parts' summaries.

    children: community, child, title, size, summary (may be null), of parts that lie wholly
    in the community.  The largest come first, each summary cut to CHILD_CHARS, until
    PROMPT_CHARS are reached; `covered` counts the notes of those included.
    """
    piece = F.concat(F.lit("--- "), "title", F.lit(" ("), F.col("size").cast("string"), F.lit(" notes)\n"), F.coalesce(F.concat(F.substring("summary", 1, CHILD_CHARS), F.lit("\n")), F.lit("")), F.lit("\n"))
    order = Window.partitionBy("community").orderBy(F.desc("size"), "child")
    rows = children.withColumn("piece", piece).withColumn("place", F.row_number().over(order))
    before = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("taken", F.coalesce(before, F.lit(0)) < PROMPT_CHARS)
    kept = F.when(F.col("taken"), F.struct("place", "piece"))
    out = rows.groupBy("community").agg(F.count("*").alias("children"), F.count_if("taken").alias("included"), F.sum(F.when(F.col("taken"), F.col("size"))).alias("covered"), F.array_sort(F.collect_list(kept)).alias("parts"))
    return out.select("community", "children", "included", "covered", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("prompt"))
