"""Incremental maintenance from a stream of changes, and per-key stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

CHANGE = "seq long, path string, op string, new_path string, revision string, text string, author string, ts timestamp"


def change_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Changes as they are appended to a folder of Parquet files; nothing is dropped."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def latest(changes: DataFrame) -> DataFrame:
    """One row a path: its last change, renames taken as a removal and an addition."""
    here = changes.select("seq", "path", F.col("op").isin("delete", "rename").alias("gone"), "revision", "text")
    moved = changes.where("op = 'rename' and new_path is not null").select("seq", F.col("new_path").alias("path"), F.lit(False).alias("gone"), "revision", "text")
    value = F.struct("seq", "gone", "revision", "text")
    return here.unionAll(moved).groupBy("path").agg(F.max_by(value, "seq").alias("v")).select("path", "v.*")


def upsert(batch: DataFrame, current: DataFrame | None) -> DataFrame:
    """The state (path, seq, gone, revision, text) after a batch; applying one twice changes nothing.

    Removed paths stay as markers, so a late older change cannot bring them back.
    """
    fresh = latest(batch)
    if current is None:
        return fresh
    both = current.select("path", "seq", "gone", "revision", "text").unionAll(fresh.select("path", "seq", "gone", "revision", "text"))
    return both.groupBy("path").agg(F.max_by(F.struct("seq", "gone", "revision", "text"), "seq").alias("v")).select("path", "v.*")


def maintain(changes: DataFrame, folder: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame] | None = None):
    """Keep the state of a change stream as versions below a folder, one a micro-batch.

    A version is the one before it with the batch applied, under the batch's number; a batch
    that is repeated after a failure writes the same version again.  Versions before the
    last two are removed.  From the second batch on the version before must be there.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number - 1}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if number and not there:
            raise FileNotFoundError(f"version {number - 1} is missing below {folder}")
        state = upsert(batch, spark.read.parquet(f"{folder}/{number - 1}") if there else None)
        (state if derive is None else derive(state)).write.mode("overwrite").parquet(f"{folder}/{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def debounced(changes: DataFrame, quiet: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """author, first, last, changes: bursts of changes with no gap of `quiet`, once they are over."""
    bursts = changes.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "author").agg(F.count("*").alias("changes"), F.max("ts").alias("last"))
    return bursts.select("author", F.col("w.start").alias("first"), "last", "changes")


def coalesced(events: DataFrame, quiet: float, most: float, late: str = "0 seconds") -> DataFrame:
    """key, first, last, changes, fires: `history.coalesced` of a stream; a batch is told once time has passed it.

    events: key string, seq long, epoch double.  A batch of a key ends `quiet` seconds after
    its last change, or `most` after its first one, whichever is sooner; a timer of the
    stream's watermark ends it where no later change does.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        out = []
        frames = [] if state.hasTimedOut else list(parts)
        for t in pd.concat(frames).sort_values(["epoch", "seq"])["epoch"] if frames else []:
            if n and (t - last >= quiet or t - first >= most):
                out.append((first, last, n))
                n = 0
            first, last, n = (first if n else t), t, n + 1
        now = state.getCurrentWatermarkMs() / 1000
        if n and now >= min(last + quiet, first + most):
            out.append((first, last, n))
            n = 0
        if n:
            state.update((float(first), float(last), int(n)))
            state.setTimeoutTimestamp(max(int(1000 * min(last + quiet, first + most)), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(key[0], f, e, m, min(e + quiet, f + most)) for f, e, m in out], columns=["key", "first", "last", "changes", "fires"])

    timed = events.withColumn("ts", F.timestamp_micros((F.col("epoch") * 1_000_000).cast("long"))).withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(run, "key string, first double, last double, changes long, fires double", "first double, last double, n long", "append", "EventTimeTimeout")


def limited(events: DataFrame, capacity: float = 60, refill: float = 10) -> DataFrame:
    """key, seq, allowed: a token bucket a key, its level kept between micro-batches.

    events: key string, seq long, epoch double.  A batch's events are taken in their order.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, at = state.get if state.exists else (capacity, None)
        frame = pd.concat(list(parts)).sort_values(["epoch", "seq"])
        out = []
        for t in frame["epoch"]:
            level = min(capacity, level + max(0.0, t - (t if at is None else at)) * refill)
            at = t if at is None else max(at, t)
            out.append(level >= 1)
            level -= out[-1]
        state.update((float(level), float(at)))
        yield pd.DataFrame({"key": key[0], "seq": frame["seq"], "allowed": out})

    return events.groupBy("key").applyInPandasWithState(run, "key string, seq long, allowed boolean", "level double, at double", "append", "NoTimeout")


def captured(captures: DataFrame) -> DataFrame:
    """session_id, bytes, started_at, ended_at: each session's largest capture so far (update mode)."""
    best = F.max_by(F.struct("bytes", "ended_at"), F.struct("bytes", "ended_at"))
    return captures.groupBy("session_id").agg(best.alias("b"), F.min("started_at").alias("started_at")).select("session_id", "b.bytes", "started_at", "b.ended_at")


def readable(events: DataFrame, grants: DataFrame) -> DataFrame:
    """Events of the vaults that each principal may read (a stream joined with a table)."""
    return events.join(grants.select("principal", "vault"), "vault")


def attach(fresh: DataFrame, placed: DataFrame, threshold: float = 0.75) -> DataFrame:
    """node, community: where new notes (id, vec) belong, by votes of similar placed ones (id, vec, community)."""
    from loomnote.operators import graph, search

    asked = fresh.select(F.col("id").alias("query_id"), "vec")
    near = search.knn(placed.select(F.col("id").alias("chunk_id"), "vec"), asked, graph.NEIGHBOURS)
    near = near.where(F.col("score") >= (1 + threshold) / 2).select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b"), (2 * F.col("score") - 1).alias("score"))
    return graph.vote(near, placed.select(F.col("id").alias("node"), "community")).select("node", "community")


def attach_pass(fresh: DataFrame, placed: DataFrame, threshold: float = 0.75, most: int = 500) -> DataFrame:
    """node, community of the first `most` new notes by id; a null community means that no neighbour is near enough yet."""
    now = fresh.select("id", "vec").orderBy("id").limit(most)
    return now.select(F.col("id").alias("node")).join(attach(now, placed, threshold), "node", "left")


def attach_pending(spark: SparkSession, folder: str, number: int, arrived: DataFrame, placed: DataFrame, threshold: float = 0.75, most: int = 500) -> DataFrame:
    """One pass of attachment with kept state: node, community, since of the communities below `folder`.

    arrived: id, vec of new notes.  placed: id, vec, community as the last whole detection
    left them.  New notes that no placed one is near wait; every pass tries the first `most`
    of the waiting, by the pass of their arrival and id, against all placed ones, those that
    earlier passes placed too.  `since` counts the notes a community got since its summary.
    A pass that runs twice writes the same version; versions before the last two go.
    """
    version = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
    store = version(0).getFileSystem(spark._jsc.hadoopConfiguration())
    if number and not store.exists(version(number - 1)):
        raise FileNotFoundError(f"pass {number - 1} is missing below {folder}")
    schema = "id string, vec array<double>, arrived int, community string"
    before = spark.read.schema(schema).parquet(f"{folder}/{number - 1}") if number else spark.createDataFrame([], schema)
    fresh = arrived.select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.lit(number).alias("arrived"), F.lit(None).cast("string").alias("community"))
    known = before.select("id").unionAll(placed.select(F.col("id").cast("string").alias("id")))
    state = before.unionAll(fresh.dropDuplicates(["id"]).join(known, "id", "left_anti").select(before.columns))
    asked = state.where("community is null").orderBy("arrived", "id").limit(most)
    there = placed.select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.col("community").cast("string").alias("community"))
    found = attach(asked.select("id", "vec"), there.unionAll(before.where("community is not null").select("id", "vec", "community")), threshold)
    after = state.join(found.select(F.col("node").alias("id"), F.col("community").alias("got")), "id", "left")
    after.select("id", "vec", "arrived", F.coalesce("community", "got").alias("community")).write.mode("overwrite").parquet(f"{folder}/{number}")
    if number > 1:
        store.delete(version(number - 2), True)
    rows = spark.read.schema(schema).parquet(f"{folder}/{number}")
    since = rows.where("community is not null").groupBy("community").agg(F.count("id").alias("since"))
    return rows.join(since, "community", "left").select(F.col("id").alias("node"), "community", "since")


class Progress(StreamingQueryListener):
    """Rows that a running stream has handled: done, of `total` if that is known, rows a second, seconds left.

    Add it with `spark.streams.addListener`; `name` is the stream's query name.
    """

    def __init__(self, name: str, total: int | None = None):
        self.name, self.total, self.done, self.rate, self.ended = name, total, 0, 0.0, False
        self.run: str | None = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.run, self.ended = str(event.runId), False

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.name == self.name:
            self.done += event.progress.numInputRows
            self.rate = event.progress.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) == self.run:
            self.ended = True

    def now(self) -> dict:
        left = None if self.total is None or not self.rate else max(0.0, self.total - self.done) / self.rate
        return {"done": self.done, "total": self.total, "rate": round(self.rate, 3), "left": left, "ended": self.ended}
