"""Context packs: cited blocks of notes within a budget of estimated tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote.functions import text as T

#: Budget, seeds for expansion, notes that an enumeration returns at most.
BUDGET, SEEDS, MOST = 2000, 3, 500


def first_per_note(ranked: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id", "path").orderBy("rank")
    return ranked.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def within_budget(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, path, place, tokens: blocks taken greedily by rank.

    A block that would overflow is skipped, unless it is the first, and costs nothing; once
    the budget is reached nothing more is taken.  blocks: query_id, rank, path, text.  A
    query's blocks, at most the candidate window, are folded in one array.
    """
    each = blocks.select("query_id", F.struct("rank", "path", T.tokens_estimate(F.col("text")).alias("tokens")).alias("b"))
    rows = each.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.expr("cast(array() as array<struct<rank: bigint, path: string, tokens: bigint>>)").alias("kept"))

    def step(state, block):
        full = (F.size(state["kept"]) > 0) & ((state["total"] + block["tokens"] > budget) | (state["total"] >= budget))
        one = F.struct(block["rank"].cast("long").alias("rank"), block["path"].alias("path"), block["tokens"].alias("tokens"))
        more = F.struct((state["total"] + block["tokens"]).alias("total"), F.concat(state["kept"], F.array(one)).alias("kept"))
        return F.when(full, state).otherwise(more)

    kept = rows.select("query_id", F.posexplode(F.aggregate("all", start, step)["kept"]).alias("place", "b"))
    return kept.select("query_id", F.col("b.path").alias("path"), (F.col("place") + 1).cast("long").alias("place"), F.col("b.tokens").alias("tokens"))


def enumerate_notes(notes: DataFrame, most: int = MOST) -> DataFrame:
    """Every note given, whole, by path, whatever its size: a rule book."""
    return notes.select("path", T.tokens_estimate(F.col("text")).alias("tokens")).orderBy("path").limit(most)


def expansion(packed: DataFrame, resolved: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """query_id, path, via, rank: neighbours of the first blocks, outlinks before backlinks."""
    first = packed.where(F.col("place") <= seeds).select("query_id", F.col("path").alias("seed"), F.col("place").alias("seed_place"))
    edges = resolved.where("resolved is not null").select(F.col("src").alias("seed"), F.col("resolved").alias("path"), F.lit(0).alias("way"), F.col("pos").cast("long").alias("pos"), F.lit("").alias("by"))
    back = resolved.where("resolved is not null").select(F.col("resolved").alias("seed"), F.col("src").alias("path"), F.lit(1).alias("way"), F.lit(0).cast("long").alias("pos"), F.col("src").alias("by"))
    near = first.join(edges.unionAll(back), "seed").where("path <> seed")
    near = near.join(packed.select("query_id", "path"), ["query_id", "path"], "left_anti")
    own = Window.partitionBy("query_id", "path").orderBy("seed_place", "way", "pos", "by")
    once = near.withColumn("turn", F.row_number().over(own)).where("turn = 1")
    order = Window.partitionBy("query_id").orderBy("seed_place", "way", "pos", "path")
    return once.select("query_id", "path", F.col("seed").alias("via"), F.row_number().over(order).cast("long").alias("rank"))


def with_provenance(blocks: DataFrame, touched: DataFrame) -> DataFrame:
    """Blocks with the last commit and author of their notes."""
    return blocks.join(touched, "path", "left")
