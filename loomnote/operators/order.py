"""Global positions without a global sort in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir` or, in local mode without one, a folder of our own."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="loomnote-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """Adds each row's place (from 0) in an order that leaves no ties.

    Rows are dealt by range and sorted within tasks; only the tasks' sizes, one row a task,
    are summed in one place.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, inner = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    return dealt.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + inner).cast("long")).drop("__id", "__part", "__before")
