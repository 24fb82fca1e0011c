"""A kept table of resolved links; a change resolves again only what it can change.

A link's target is found by the keys that paths offer: themselves, themselves without
.md, and their lower-cased last name, if no other path has it.  Where a path appears or
goes, the links that ask for one of its keys are resolved anew, and so are the links of
changed notes; all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.functions import text as T
from loomnote.operators import links
from loomnote.operators.generations import Generations

_LINKS = "src string, pos int, target string, resolved string"


def _asked(target: Column) -> list[Column]:
    """The keys that a link's target asks for."""
    page = T.link_page(target)
    return [F.concat(F.lit("="), page), F.concat(F.lit("~"), F.lower(T.stem(page)))]


def _offered(path: Column) -> list[Column]:
    bare = F.when(path.endswith(".md"), F.concat(F.lit("="), F.regexp_replace(path, r"\.md$", "")))
    return [F.concat(F.lit("="), path), bare, F.concat(F.lit("~"), F.lower(T.stem(path)))]


def _keyed(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))))


class LinkIndex(Generations):
    """Links (src, pos, target, resolved) below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, {"paths": "path string, here boolean", "links": _LINKS, "sources": "src string"})

    def paths(self) -> DataFrame:
        """The notes that are there."""
        return self._newest(self._read("paths"), self._read("paths"), "path").where("here").select("path")

    def links(self) -> DataFrame:
        """src, pos, target, resolved of every link."""
        return self._newest(self._read("links"), self._read("sources"), "src").select("src", "pos", "target", "resolved")

    def apply(self, notes: DataFrame, removed: DataFrame | None = None, generation: int | None = None) -> int:
        """Take changed or new notes (path, text) and the paths of removed ones; a done generation is not applied again.

        A path in both is a changed note.  A rename is a removal and a new note.
        """
        gen, done = self.following(generation)
        if done:
            return gen
        notes = notes.where("path is not null").select("path", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["path"])
        before = self.paths()
        fresh = notes.select("path").join(before, "path", "left_anti")
        removed = self.spark.createDataFrame([], "path string") if removed is None else removed.select("path").distinct()
        gone = removed.join(notes.select("path"), "path", "left_anti").join(before, "path", "left_semi")
        self._write(fresh.withColumn("here", F.lit(True)).unionAll(gone.withColumn("here", F.lit(False))), "paths", gen)
        moved = self._own("paths", gen)
        after = before.join(moved.where("not here").select("path"), "path", "left_anti").unionAll(moved.where("here").select("path"))
        # links that ask for a key of a path that came or went
        keys = _keyed(moved, _offered(F.col("path"))).select("key").distinct()
        touched = notes.select(F.col("path").alias("src")).unionAll(removed.select(F.col("path").alias("src"))).distinct()
        held = self.links().select("src", "pos", "target").join(touched, "src", "left_anti")
        sources = _keyed(held.select("src", "target"), _asked(F.col("target"))).join(keys, "key", "left_semi").select("src").distinct()
        self._write(sources.unionAll(touched), "sources", gen)
        again = held.join(self._own("sources", gen), "src", "left_semi").unionAll(links.extract(notes).select("src", F.col("pos").cast("int").alias("pos"), "target"))
        # of the paths only those that offer a key these links ask for
        wanted = _keyed(again.select("target"), _asked(F.col("target"))).select("key").distinct()
        offers = _keyed(after, _offered(F.col("path"))).join(wanted, "key", "left_semi").select("path").distinct()
        self._write(links.resolve(again, offers).select("src", "pos", "target", "resolved"), "links", gen)
        self._write(self.spark.createDataFrame([(gen == 0,)], "base boolean"), "done", gen)
        return gen

    def compact(self) -> None:
        """All that counts as one generation; the older ones' files go."""
        old = self.generations()
        gen = max(old, default=-1) + 1
        self._write(self.paths().withColumn("here", F.lit(True)), "paths", gen)
        self._write(self.links(), "links", gen)
        self._write(self.links().select("src").distinct(), "sources", gen)
        self._write(self.spark.createDataFrame([(True,)], "base boolean"), "done", gen)
        self._forget(old)
