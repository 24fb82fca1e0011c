"""Tables kept below a folder as generations, one a change, each written whole or not at all.

A generation counts once its row in `done` is there.  A generation that is a base (a
compacted one) makes all before it count no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    """The tables of `schemas` (without the column gen, which each has) below `root`."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {**schemas, "done": ", ".join(x for x in ("base boolean", schemas.get("done")) if x)}

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _all(self, name: str) -> DataFrame:
        store, path = self._path(name)
        if not store.exists(path):
            return self.spark.createDataFrame([], self.schemas[name] + ", gen int")
        return self.spark.read.schema(self.schemas[name] + ", gen int").parquet(f"{self.root}/{name}")

    def generations(self) -> list[int]:
        """Those that count: the last base and all after it."""
        rows = sorted((r.gen, r.base) for r in self._all("done").select("gen", "base").collect())  # one row a change
        first = max((g for g, base in rows if base), default=0)
        return [g for g, _ in rows if g >= first]

    def following(self, generation: int | None) -> tuple[int, bool]:
        """The number of a change, and whether it is done already."""
        done = [r.gen for r in self._all("done").select("gen").collect()]
        gen = max(done, default=-1) + 1 if generation is None else generation
        return gen, gen in done

    def _read(self, name: str) -> DataFrame:
        return self._all(name).where(F.col("gen").isin(self.generations()))

    def _own(self, name: str, gen: int) -> DataFrame:
        """What a generation, done or not, has in a table."""
        return self._all(name).where(F.col("gen") == gen).drop("gen")

    def _write(self, rows: DataFrame, name: str, gen: int, by: str | None = None) -> None:
        out = rows.write.mode("overwrite").option("compression", "zstd")
        # the finished job's shuffle files are of no more use; what was set before holds again
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            (out.partitionBy(by) if by else out).parquet(f"{self.root}/{name}/gen={gen}")
        finally:
            self.spark.conf.set(key, before)

    def _drop(self, name: str, gen: int) -> None:
        store, path = self._path(f"{name}/gen={gen}")
        store.delete(path, True)

    def _newest(self, rows: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
        """Rows whose key no later generation has replaced."""
        if len(self.generations()) < 2:
            return rows
        last = replaced.groupBy(key).agg(F.max("gen").alias("last"))
        return rows.join(last, key, "left").where("last is null or gen >= last").drop("last")

    def _forget(self, gens: list[int]) -> None:
        for name in self.schemas:
            for g in gens:
                self._drop(name, g)
