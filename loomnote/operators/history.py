"""Commits and changes: snapshots, diffs, as-of lookups, history, provenance, trash.

commits: seq, commit, author, epoch, message.  changes: seq, path, op (add, modify,
delete, rename), new_path, revision.  The latest change a path decides; it is found by
an aggregate of one row a path and task, so hot paths do not gather.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote.operators.order import cut


#: So many commits are sent to every task; more are shuffled.
FEW = 100_000


def snapshot(changes: DataFrame, seq: int | None = None) -> DataFrame:
    """path, revision, seq: what exists after a commit (after all, if none is named)."""
    rows = changes if seq is None else changes.where(F.col("seq") <= seq)
    away = rows.select("seq", "path", F.when(F.col("op").isin("delete", "rename"), F.lit(None)).otherwise(F.col("revision")).alias("revision"))
    moved = rows.where("op = 'rename' and new_path is not null").select("seq", F.col("new_path").alias("path"), "revision")
    latest = away.unionAll(moved).groupBy("path").agg(F.max_by("revision", "seq").alias("revision"), F.max("seq").alias("seq"))
    return latest.where("revision is not null").select("path", "revision", "seq")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (ADD, MODIFY, DELETE): how two snapshots differ."""
    a, b = old.select("path", F.col("revision").alias("a")), new.select("path", F.col("revision").alias("b"))
    kind = F.when(F.col("a").isNull(), "ADD").when(F.col("b").isNull(), "DELETE").when(F.col("a") != F.col("b"), "MODIFY")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change")).where("change is not null")


def renames(changed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """path, new_path: deleted notes whose exact content was added elsewhere (smallest path)."""
    gone = changed.where("change = 'DELETE'").select("path").join(old.select("path", "revision"), "path")
    came = changed.where("change = 'ADD'").select("path").join(new.select("path", "revision"), "path").groupBy("revision").agg(F.min("path").alias("new_path"))
    return gone.join(came, "revision").select("path", "new_path")


def commit_at(commits: DataFrame, moments: DataFrame) -> DataFrame:
    """moment, seq, commit: for each moment the last commit not after it.

    Both are sorted together once and the last commit is carried forward within hour
    buckets; what a bucket opens with is carried over the buckets before it.
    """
    marks = commits.select("epoch", "seq", "commit").unionByName(moments.select(F.col("moment").alias("epoch")), allowMissingColumns=True)
    marks = marks.withColumn("bucket", F.floor(F.col("epoch") / 3600))
    last = commits.groupBy(F.floor(F.col("epoch") / 3600).alias("bucket")).agg(F.max_by(F.struct("seq", "commit"), F.struct("epoch", "seq")).alias("last"))
    inside = Window.partitionBy("bucket").orderBy("epoch", F.col("seq").isNull(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = marks.withColumn("own", F.last(F.when(F.col("seq").isNotNull(), F.struct("seq", "commit")), True).over(inside)).where("seq is null")
    # what a bucket opens with: at most one row an hour, whatever the number of commits
    hours = last.join(carried.where("own is null").select("bucket").distinct(), "bucket", "full_outer")
    opening = hours.select("bucket", F.last("last", True).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("last"))
    out = carried.select("epoch", "bucket", "own").distinct().join(opening, "bucket", "left")
    found = F.coalesce("own", "last")
    return out.select(F.col("epoch").alias("moment"), found["seq"].alias("seq"), found["commit"].alias("commit")).where("seq is not null")


def last_touch(changes: DataFrame, commits: DataFrame, seq: int | None = None) -> DataFrame:
    """path, commit, author: the last commit that touched each path, up to a commit."""
    rows = changes if seq is None else changes.where(F.col("seq") <= seq)
    latest = rows.groupBy("path").agg(F.max("seq").alias("seq"))
    return latest.join(commits.select("seq", "commit", "author"), "seq").select("path", "commit", "author")


def history(changes: DataFrame, commits: DataFrame, most: int = 100) -> DataFrame:
    """path, place, seq, author: each path's latest commits, newest first."""
    order = Window.partitionBy("path").orderBy(F.desc("seq"))
    ranked = changes.select("path", "seq").distinct().withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)
    return ranked.join(commits.select("seq", "author"), "seq").select("path", "place", "seq", "author")


def attribution(changes: DataFrame) -> DataFrame:
    """path, added_seq, last_seq: the latest commit that added a path, and its last change."""
    return changes.groupBy("path").agg(F.max(F.when(F.col("op") == "add", F.col("seq"))).alias("added_seq"), F.max("seq").alias("last_seq"))


def trash(commits: DataFrame) -> DataFrame:
    """trash_path, origin, deleted_at: what deletions' messages say; the latest a trash path."""
    pattern = r"^delete: (.+) -> (\.trash/.+)$"
    rows = commits.select("seq", "epoch", F.regexp_extract("message", pattern, 1).alias("origin"), F.regexp_extract("message", pattern, 2).alias("trash_path")).where("trash_path <> ''")
    return rows.groupBy("trash_path").agg(F.max_by("origin", "seq").alias("origin"), F.max_by("epoch", "seq").alias("deleted_at"))


def sessions(commits: DataFrame, quiet: int) -> DataFrame:
    """author, first_epoch, last_epoch, commits: runs of commits less than `quiet` seconds apart."""
    order = Window.partitionBy("author").orderBy("epoch", "seq")
    gap = F.coalesce(F.col("epoch") - F.lag("epoch").over(order) > quiet, F.lit(True)).cast("int")
    numbered = commits.withColumn("gap", gap).withColumn("run", F.sum("gap").over(order))
    return numbered.groupBy("author", "run").agg(F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.count("*").alias("commits")).drop("run")


def ancestors(parents: DataFrame, start: str, checkpoint: bool = True) -> DataFrame:
    """commit: all that a commit descends from, itself included (parents: commit, parent).

    One join a generation from the commits found last; commits met before are not followed
    again, so merges do not multiply.  The parents are written once and stay where they are:
    of both sides of a join it is the commits found, if they are FEW, that go to every task;
    else both are shuffled.
    """
    edges = parents.where("parent is not null").select("commit", "parent").distinct()
    edges = cut(edges) if checkpoint else edges
    found = frontier = edges.sparkSession.createDataFrame([(start,)], "commit string")
    last, total = 1, 1

    def small(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows) if n <= FEW else rows.hint("merge")

    while True:
        reached = edges.join(small(frontier, last), "commit").select(F.col("parent").alias("commit")).distinct().join(small(found, total), "commit", "left_anti")
        frontier = cut(reached) if checkpoint else reached
        last = frontier.count()
        if not last:
            return found
        found, total = found.unionAll(frontier), total + last


def coalesced(events: DataFrame, quiet: float, most: float) -> DataFrame:
    """key, first, last, changes, fires: changes of a key in batches, each run once.

    A batch ends when `quiet` seconds pass without a change, or `most` after its first one.
    events: key, seq, epoch.  A key's events are folded in order, as for `token_bucket`.
    """
    import pyarrow as pa

    def run(batches):
        key, first, last, n = None, None, None, 0

        def told(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], None if i == 0 else pa.int64() if i == 3 else pa.float64()) for i in range(5)], names=["key", "first", "last", "changes", "fires"])

        for batch in batches:
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("epoch").to_pylist(), strict=True):
                if k != key or t - last >= quiet or t - first >= most:
                    if n:
                        out.append((key, first, last, n, min(last + quiet, first + most)))
                    key, first, n = k, t, 0
                last, n = t, n + 1
            if out:
                yield told(out)
        if n:
            yield told([(key, first, last, n, min(last + quiet, first + most))])

    kind = events.schema["key"].dataType.simpleString()
    ordered = events.select("key", "seq", F.col("epoch").cast("double")).where("key is not null").repartition("key").sortWithinPartitions("key", "epoch", "seq")
    return ordered.mapInArrow(run, f"key {kind}, first double, last double, changes long, fires double")


def token_bucket(events: DataFrame, capacity: float = 60, refill: float = 10) -> DataFrame:
    """key, seq, allowed: a bucket a key, refilled by the second; one ordered fold a key.

    events: key, seq, epoch (seconds, may be fractional).  A key's events are folded in
    batches of Arrow rows in their order; only the level and the time are kept.
    """
    import pyarrow as pa

    def run(batches):
        key, level, at = None, capacity, 0.0
        for batch in batches:
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("epoch").to_pylist(), strict=True):
                if k != key:
                    key, level, at = k, capacity, t
                level = min(capacity, level + (t - at) * refill)
                at = t
                out.append(level >= 1)
                level -= out[-1]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), pa.array(out, pa.bool_())], names=["key", "seq", "allowed"])

    kind = events.schema["key"].dataType.simpleString()
    ordered = events.select("key", "seq", F.col("epoch").cast("double")).repartition("key").sortWithinPartitions("key", "epoch", "seq")
    return ordered.mapInArrow(run, f"key {kind}, seq long, allowed boolean")
