"""Predicates over notes and chunks.

Columns used where asked for: path, tags, type, status, created, expires_at,
superseded_by, needs_review.  All predicates are null-safe: a note without a status, say,
is not hidden by the rule that hides revoked ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Namespaces and statuses that recall treats apart.
DRAFTS, SESSIONS, TRASH = "messy/", "messy/sessions/", ".trash/"
HIDDEN_STATUSES = ("revoked", "provisional")
RANKS = {"READER": 1, "WRITER": 2, "MAINTAINER": 3}


@dataclass
class Filters:
    """What a caller may ask for; everything left out does not restrict."""

    tags: list[str] = field(default_factory=list)
    path_prefix: str | None = None
    type: str | None = None
    status: str | None = None
    created_from: int | None = None
    created_to: int | None = None
    include_all: bool = False
    include_drafts: bool = False

    @property
    def is_empty(self) -> bool:
        """True if nothing restricts; include_all alone does not."""
        return not (self.tags or self.path_prefix or self.type or self.status or self.created_from is not None or self.created_to is not None)


def has_tags(tags: list[str]) -> Column:
    wanted = F.array(*map(F.lit, tags))
    return F.size(F.array_intersect("tags", wanted)) == len(set(tags))


def created_between(first: int | None, last: int | None) -> Column:
    """Both ends count; notes without a creation time fall out as soon as a bound is set."""
    out = F.lit(True)
    if first is not None:
        out &= F.coalesce(F.col("created") >= first, F.lit(False))
    if last is not None:
        out &= F.coalesce(F.col("created") <= last, F.lit(False))
    return out


def current(now: int) -> Column:
    """Neither superseded nor expired."""
    return F.col("superseded_by").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def recalled(f: Filters, now: int) -> Column:
    """What search and browsing may return."""
    out = ~F.col("path").startswith(SESSIONS) & ~F.col("path").startswith(TRASH)
    if not (f.include_all or f.include_drafts or (f.path_prefix or "").startswith(DRAFTS)):
        out &= ~F.col("path").startswith(DRAFTS)
    if f.tags:
        out &= has_tags(f.tags)
    if f.path_prefix:
        out &= F.col("path").startswith(f.path_prefix)
    if f.type:
        out &= F.coalesce(F.col("type") == f.type.lower(), F.lit(False))
    if f.status:
        out &= F.coalesce(F.col("status") == f.status.lower(), F.lit(False))
    out &= created_between(f.created_from, f.created_to)
    if not f.include_all:
        out &= current(now)
        if not f.status:
            out &= ~F.coalesce(F.col("status"), F.lit("")).isin(*HIDDEN_STATUSES)
    return out


def awaiting_review(now: int) -> Column:
    """Provisional or flagged notes that are still current; drafts count, sessions do not."""
    asked = (F.coalesce(F.col("status"), F.lit("")) == "provisional") | F.coalesce(F.col("needs_review"), F.lit(False))
    return asked & (F.coalesce(F.col("status"), F.lit("")) != "revoked") & current(now) & ~F.col("path").startswith(SESSIONS)


def browse(rows: DataFrame, f: Filters, now: int) -> DataFrame:
    """Chunks that pass the filters, each with score 1; an empty request gives none."""
    if f.is_empty:
        return rows.limit(0).withColumn("score", F.lit(1.0))
    return rows.where(recalled(f, now)).withColumn("score", F.lit(1.0))


def valid_path(path: Column) -> Column:
    """No empty, `.` or `..` segment; top folders that begin with a dot are reserved."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..")) | parts[0].startswith(".")
    return path.isNotNull() & (path != "") & ~bad


def allowed(principals: DataFrame, grants: DataFrame, needed: str) -> DataFrame:
    """Vaults that each principal may use at a role: least of its grant and its own cap."""
    ranks = F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])
    cap = F.when(F.col("read_only"), F.lit(RANKS["READER"])).otherwise(F.lit(RANKS["MAINTAINER"]))
    joined = principals.join(grants, "principal")
    return joined.where(F.least(ranks[F.col("role")], cap) >= RANKS[needed]).select("principal", "vault")
