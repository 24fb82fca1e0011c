"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; where that is unset, in local mode only, a folder of our own."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="loomnote-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


#: Arrow batches of at most so many bytes reach the operators' Python code.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for this session, unless it asks for smaller ones already.

    The setting stays, since results are read after the operator has returned.  A batch exists in the JVM, in Python and often once more as a result; Spark's usual
    64 MB a task are a large part of a small executor.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is not None and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[str]:
    """Column names for select, whatever characters they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


#: So many ids, some 16 MB, are sent to every executor rather than shuffled for.
FEW_IDS = 500_000


def narrowed(rows: DataFrame, ids: DataFrame, key: str, most: int = FEW_IDS) -> DataFrame:
    """`rows` without most of those whose key is not among `ids`, before a join on it.

    The ids (a written table) are counted; a bounded number of them is broadcast, so that
    the join that follows shuffles the wanted rows only.  Beyond the bound rows stay as
    they are and that join does all the work.
    """
    keys = ids.select(key).distinct()
    if keys.count() > most:
        return rows
    return rows.join(F.broadcast(keys), key, "left_semi")


class Tables:
    """Intermediate results, written once and reread; `drop` removes them again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.root = f"{folder(spark)}/loomnote-{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # the finished job's shuffle files are of no more use; what was set before holds again
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            frame.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, frame: DataFrame) -> DataFrame:
        """The result as a reliable checkpoint; every intermediate table goes."""
        folder(self.spark)
        out = frame.checkpoint()
        self.drop()
        return out
