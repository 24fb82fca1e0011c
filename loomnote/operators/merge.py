"""Writes and merges as joins: batch writes, guards, three-way plans, source sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_outcomes(requests: DataFrame, current: DataFrame, flagged: Column) -> DataFrame:
    """path, outcome: written, unchanged, secret, differs or conflict, for each requested write.

    requests: path, content, overwrite, expected (revision or null).  current: path,
    content, revision.  `flagged` says of a request's content that it holds a secret.
    """
    now = current.select("path", F.col("content").alias("have"), "revision", F.lit(True).alias("there"))
    rows = requests.join(now, "path", "left")
    outcome = (
        F.when(flagged, "secret")
        .when(F.col("there").isNull(), "written")
        .when(F.col("have") == F.col("content"), "unchanged")
        .when(~F.col("overwrite"), "differs")
        .when(F.col("expected").isNotNull() & (F.col("expected") != F.col("revision")), "conflict")
        .otherwise("written")
    )
    return rows.select("path", outcome.alias("outcome"))


def guard_failures(guards: DataFrame, current: DataFrame) -> DataFrame:
    """path, expected, actual: guards (path, expected; null: must not exist) that do not hold."""
    now = current.select("path", F.col("revision").alias("actual"))
    return guards.join(now, "path", "left").where(~F.col("expected").eqNullSafe(F.col("actual"))).select("path", "expected", "actual")


def optimistic(requests: DataFrame, current: DataFrame) -> DataFrame:
    """path, outcome, actual: writes that expect a revision; conflicts tell the actual one."""
    now = current.select("path", F.col("revision").alias("actual"))
    rows = requests.join(now, "path", "left")
    return rows.select("path", F.when(F.col("expected").eqNullSafe(F.col("actual")), "written").otherwise("conflict").alias("outcome"), "actual")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path, action: keep, take, delete, merge (both changed a text) or conflict.

    Each side: path, revision.  A side that lacks a path has deleted it or never had it.
    """
    rows = base.select("path", F.col("revision").alias("b")).join(ours.select("path", F.col("revision").alias("o")), "path", "full_outer").join(theirs.select("path", F.col("revision").alias("t")), "path", "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    action = (
        F.when(o.eqNullSafe(t) | t.eqNullSafe(b), "keep")
        .when(o.eqNullSafe(b), F.when(t.isNull(), "delete").otherwise("take"))
        .when(o.isNull() | t.isNull(), "conflict")
        .when(F.col("path").endswith(".md"), "merge")
        .otherwise("conflict")
    )
    return rows.select("path", action.alias("action"))


def source_plan(external: DataFrame, vault: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, action: create, unchanged, push, quiet, update, conflict, orphaned or pruned.

    external and vault: path, hash.  manifest: path, ext, vault (hashes at the last sync).
    """
    e, v, m = external.select("path", F.col("hash").alias("e")), vault.select("path", F.col("hash").alias("v")), manifest.select("path", F.col("ext").alias("me"), F.col("vault").alias("mv"), F.lit(True).alias("known"))
    rows = e.join(m, "path", "full_outer").join(v, "path", "left")
    action = (
        F.when(F.col("e").isNull(), F.when(F.col("v").isNull(), "pruned").otherwise("orphaned"))
        .when(F.col("v").isNull(), "create")
        .when(F.col("e") == F.col("v"), F.when(F.col("known") & (F.col("me") == F.col("e")) & (F.col("mv") == F.col("v")), "unchanged").otherwise("quiet"))
        .when(F.col("known") & (F.col("mv") == F.col("v")), "update")
        .when(F.col("known") & (F.col("me") == F.col("e")), "push")
        .otherwise("conflict")
    )
    return rows.select("path", action.alias("action"))


def merged_list(base: Column, ours: Column, theirs: Column) -> Column:
    """A three-way frontmatter list: the side that changed, else both changes united, ours first.

    A null list is a missing key.
    """
    both = F.array_union(F.coalesce(ours, F.array().cast("array<string>")), F.coalesce(theirs, F.array().cast("array<string>")))
    return F.when(ours.eqNullSafe(theirs) | theirs.eqNullSafe(base), ours).when(ours.eqNullSafe(base), theirs).otherwise(both)


def merged_scalar(base: Column, ours: Column, theirs: Column) -> Column:
    """A three-way scalar as struct(value, conflict)."""
    clash = ~ours.eqNullSafe(theirs) & ~ours.eqNullSafe(base) & ~theirs.eqNullSafe(base)
    return F.struct(F.when(ours.eqNullSafe(base), theirs).otherwise(ours).alias("value"), clash.alias("conflict"))


def write_stats(timings: DataFrame) -> DataFrame:
    """One row: count, average, largest and last duration in ms, to three places."""
    return timings.agg(F.count("*").alias("count"), F.round(F.avg("ms"), 3).alias("avg_ms"), F.round(F.max("ms"), 3).alias("max_ms"), F.round(F.max_by("ms", F.struct("ts", "seq")), 3).alias("last_ms"))


def disk_stats(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count_if(F.col("path").endswith(".md")).alias("notes"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))


def exposition(stats: DataFrame, prefix: str = "vault") -> DataFrame:
    """line: text metrics, one a vault and figure (stats: vault, name, value)."""
    return stats.select(F.concat(F.lit(prefix + "_"), F.col("name"), F.lit('{vault="'), F.col("vault"), F.lit('"} '), F.col("value").cast("string")).alias("line"))


def sync_state(heads: DataFrame) -> DataFrame:
    """vault, state: up-to-date, fast-forward, push or diverged (heads: vault, local, remote, common ancestor)."""
    state = F.when(F.col("local").eqNullSafe(F.col("remote")), "up-to-date").when(F.col("local").eqNullSafe(F.col("common")), "fast-forward").when(F.col("remote").eqNullSafe(F.col("common")), "push").otherwise("diverged")
    return heads.select("vault", state.alias("state"))


def resolved_conflicts(conflicts: DataFrame, answers: DataFrame) -> DataFrame:
    """path, content: answers (path, choice mine, incoming or content, content) applied to conflicts (path, mine, incoming)."""
    chosen = F.when(F.col("choice") == "mine", F.col("mine")).when(F.col("choice") == "incoming", F.col("incoming")).otherwise(F.col("content"))
    return conflicts.join(answers, "path").select("path", chosen.alias("content"))
