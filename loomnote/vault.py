"""A vault of notes as one object: reading, searching, packing, linking, history, writing.

The store of record is a table of changes (seq, path, op, new_path, revision, text,
author, epoch, message).  Everything else is derived from it; a write gives back an
outcome and, if it holds, a vault with one more change.  Outcomes are `ok`, `conflict`,
`not_found`, `bad_request` and `blocked` (a secret).
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.functions import text as T
from loomnote.operators import filters, graph, history, links, markdown, memory, pack, scan, search
from loomnote.operators.order import numbered

CHANGE = "seq long, path string, op string, new_path string, revision string, text string, author string, epoch long, message string"


@dataclass
class Outcome:
    status: str
    detail: str | None = None
    revision: str | None = None


@dataclass
class Vault:
    spark: SparkSession
    changes: DataFrame
    vectors: DataFrame | None = None
    name: str = "vault"

    @classmethod
    def empty(cls, spark: SparkSession, name: str = "vault") -> Vault:
        return cls(spark, spark.createDataFrame([], CHANGE), name=name)

    @classmethod
    def of_notes(cls, notes: DataFrame, author: str = "import", name: str = "vault", epoch: int = 0, per_commit: int | None = None) -> Vault:
        """A vault whose first commit adds every note (path, text), or `per_commit` of them by path each."""
        seq = F.lit(1).cast("long")
        if per_commit is not None:
            notes, seq = numbered(notes.select("path", "text"), "place", "path"), F.floor(F.col("place") / per_commit) + 1
        rows = notes.select(seq.alias("seq"), "path", F.lit("add").alias("op"), F.lit(None).cast("string").alias("new_path"), T.blob_id(F.col("text")).alias("revision"), "text", F.lit(author).alias("author"), F.lit(epoch).cast("long").alias("epoch"), F.lit("import").alias("message"))
        return cls(notes.sparkSession, rows, name=name)

    # derived tables

    @cached_property
    def commits(self) -> DataFrame:
        each = self.changes.groupBy("seq").agg(F.min("author").alias("author"), F.min("epoch").alias("epoch"), F.min("message").alias("message"))
        return each.withColumn("commit", F.sha1(F.concat_ws("|", F.lit(self.name), F.col("seq").cast("string"), "message").cast("binary")))

    def snapshot(self, seq: int | None = None) -> DataFrame:
        """path, text, revision of what exists, without the trash."""
        there = history.snapshot(self.changes, seq).where(~F.col("path").startswith(filters.TRASH))
        blobs = self.changes.where("text is not null").groupBy("revision").agg(F.min("text").alias("text"))
        return there.select("path", "revision").join(blobs, "revision").select("path", "text", "revision")

    @cached_property
    def parsed(self) -> DataFrame:
        return markdown.parse_notes(self.snapshot().where(F.col("path").endswith(".md")))

    @cached_property
    def chunks(self) -> DataFrame:
        meta = self.parsed.drop("chunks", "title")
        return markdown.chunk_rows(self.parsed).join(meta, "path")

    @cached_property
    def resolved(self) -> DataFrame:
        now = self.snapshot().where(F.col("path").endswith(".md"))
        return links.resolve(links.extract(now), now)

    @cached_property
    def shown(self) -> DataFrame:
        """Links between notes that are not private; only these reach the graph."""
        return links.visible(self.resolved, self.parsed.where("private").select("path"))

    # reading

    def list(self, prefix: str = "") -> DataFrame:
        return self.snapshot().where(F.col("path").startswith(prefix)).select("path").orderBy("path")

    def read(self, path: str) -> DataFrame:
        return self.snapshot().where(F.col("path") == path)

    def tree(self, prefix: str = "", depth: int = 2) -> DataFrame:
        return links.folder_tree(self.list(prefix), min(max(depth, 1), 10))

    def tags(self) -> DataFrame:
        return links.tag_counts(self.parsed)

    def grep(self, pattern: str, prefix: str | None = None, literal: bool = False, ignore_case: bool = False, limit: int = 50) -> DataFrame:
        hidden = self.parsed.where("private").select("path")
        return search.grep(self.snapshot().join(hidden, "path", "left_anti"), pattern, literal, ignore_case, prefix, min(max(limit, 1), 500))

    def history(self, path: str, most: int = 50) -> DataFrame:
        return history.history(self.changes.where(F.col("path") == path), self.commits, most)

    def revision(self, path: str, revision: str) -> DataFrame:
        return self.changes.where((F.col("path") == path) & (F.col("revision") == revision)).select("path", "text", "revision").limit(1)

    def diff(self, path: str, old: str, new: str) -> DataFrame:
        a, b = (self.revision(path, r).select("path", F.col("text").alias(n)) for r, n in ((old, "old"), (new, "new")))
        return markdown.diff_rows(a.join(b, "path", "full_outer"))

    def trash(self) -> DataFrame:
        return history.trash(self.commits)

    # search

    def _queries(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, q string").select("query_id", T.words(F.col("q")).alias("terms"))

    def search(self, query: str = "", mode: str = "HYBRID", limit: int = 10, given: filters.Filters | None = None, vector: list[float] | None = None, as_of: int | None = None, now: int | None = None) -> DataFrame:
        """Ranked chunks: chunk_id, path, score, rank, snippet, degraded.  A blank query with filters browses.

        `degraded`: vectors were wanted and the vault has them, but the query has none.
        """
        given, now = given or filters.Filters(), int(time.time()) if now is None else now
        own = self if as_of is None else self.at(as_of)
        rows = own.chunks.where(filters.recalled(given, as_of or now))
        if not query.strip():
            found = filters.browse(own.chunks, given, as_of or now).select("chunk_id", "score").orderBy("chunk_id").limit(limit).withColumn("rank", F.lit(None).cast("long"))
        else:
            clauses = search.parse_query(query)
            plain = all(c["kind"] == "term" and not c["field"] and c["occur"] == "should" and c["boost"] == 1 and c["text"].isalnum() for c in clauses)
            vectors, asked = None, self._queries(query)
            if self.vectors is not None and vector is not None and as_of is None:
                vectors = rows.select("chunk_id", "content_hash").join(self.vectors, "content_hash")
                asked = asked.withColumn("vec", F.array(*map(F.lit, vector)))
            if plain or mode == "SEMANTIC" and vectors is not None:
                found = search.search(mode, rows, vectors, asked, limit).select("chunk_id", "score", "rank")
            else:
                keyword = search.scored_syntax(rows, query)
                if mode == "KEYWORD" or vectors is None:
                    found = search.top(keyword, limit).select("chunk_id", "score", "rank")
                else:
                    wide = search.window_size(limit)
                    found = search.top(search.fuse(search.top(keyword, wide), search.knn(vectors, asked, wide)), limit).select("chunk_id", "score", "rank")
        degraded = search.semantic_degraded(mode, query, self.vectors is not None, vector is not None) and as_of is None
        terms = [w for w in re.split(r"\W+", query.lower()) if w]
        return found.join(own.chunks.select("chunk_id", "path", "text"), "chunk_id").select("chunk_id", "path", "score", "rank", T.highlighted(F.col("text"), terms).alias("snippet"), F.lit(degraded).alias("degraded"))

    def at(self, epoch: int) -> Vault:
        """The vault as it was: the changes of commits not later than a moment."""
        return replace(self, changes=self.changes.where(F.col("epoch") <= epoch))

    def context_pack(self, query: str = "", budget: int = pack.BUDGET, given: filters.Filters | None = None, enumerate: bool = False, expand: bool = False, as_of: int | None = None, now: int | None = None, mode: str = "HYBRID", vector: list[float] | None = None) -> DataFrame:
        """Cited blocks: path, place, tokens, via, commit, author."""
        if expand and as_of is not None:
            raise ValueError("a pack as of a moment cannot be expanded")
        own, now = (self if as_of is None else self.at(as_of)), int(time.time()) if now is None else now
        given = given or filters.Filters()
        touched = history.last_touch(own.changes, own.commits)
        if enumerate:
            notes = own.parsed.where(filters.recalled(given, as_of or now) & ~F.col("private")).select("path").join(own.snapshot(), "path")
            return pack.with_provenance(pack.enumerate_notes(notes).withColumn("via", F.lit(None).cast("string")), touched)
        hits = self.search(query, mode, 50, given, vector, as_of, now).select(F.lit(0).cast("long").alias("query_id"), "rank", "path")
        texts = own.snapshot().select("path", "text")
        blocks = pack.first_per_note(hits).join(texts, "path").withColumn("via", F.lit(None).cast("string"))
        if expand:
            packed = pack.within_budget(blocks, budget)
            near = pack.expansion(packed, own.shown).join(texts, "path").withColumn("rank", F.col("rank") + 1000)
            blocks = blocks.select("query_id", "rank", "path", "text", "via").unionByName(near.select("query_id", "rank", "path", "text", "via"))
        packed = pack.within_budget(blocks, budget).join(blocks.select("path", "via").distinct(), "path")
        return pack.with_provenance(packed.drop("query_id"), touched).orderBy("place")

    # links and graph

    def link(self, path: str) -> DataFrame:
        """Where a note's links lead."""
        return self.resolved.where(F.col("src") == path).select("pos", "target", "resolved")

    def graph_query(self, path: str) -> DataFrame:
        """A note's neighbours: path, way (out or in)."""
        r = self.shown
        out = r.where(F.col("src") == path).select(F.col("resolved").alias("path"), F.lit("out").alias("way"))
        return out.unionAll(r.where(F.col("resolved") == path).select(F.col("src").alias("path"), F.lit("in").alias("way"))).distinct()

    def graph_edges(self) -> DataFrame:
        r = self.shown.select(F.col("src").alias("a"), F.col("resolved").alias("b"), F.lit("LINK").alias("kind"), F.lit(graph.LINK_WEIGHT).alias("weight"))
        if self.vectors is not None:
            means = search.mean_vectors(self.chunks.select("path", "content_hash").join(self.vectors, "content_hash"))
            r = r.unionAll(graph.similar(means.select(F.col("path").alias("id"), "vec")).select("a", "b", F.lit("SIM").alias("kind"), F.col("score").alias("weight")))
        return graph.canonical(r)

    def graph_communities(self) -> DataFrame:
        return graph.communities(self.parsed.where("not private").select(F.col("path").alias("node")), self.graph_edges())

    def graph_community(self, community: str, level: int = 0) -> DataFrame:
        """The notes of a community at a level, by path."""
        rows = self.graph_communities().where((F.col("level") == level) & (F.col("community") == community))
        return rows.select(F.col("node").alias("path")).orderBy("path")

    def graph_status(self) -> DataFrame:
        """One row: nodes, edges by kind, communities of the last level, notes with a vector and their share."""
        found = self.graph_communities()
        last = found.join(found.agg(F.max("level").alias("level")), "level").select("node", "community")
        nodes = self.parsed.where("not private").select(F.col("path").alias("node"))
        vectors = self.chunks.join(self.vectors, "content_hash").select(F.col("path").alias("id")) if self.vectors is not None else nodes.limit(0).withColumnRenamed("node", "id")
        return graph.status(nodes, self.graph_edges(), last, vectors)

    # writing

    def _held(self, path: str):
        return self.read(path).first()

    def _add(self, rows: list[tuple], message: str, author: str, epoch: int | None) -> Vault:
        last = self.changes.agg(F.max("seq")).first()[0] or 0
        when = int(time.time()) if epoch is None else epoch
        made = self.spark.createDataFrame([(last + 1, p, op, n, None, t, author, when, message) for p, op, n, t in rows], CHANGE)
        made = made.withColumn("revision", F.when(F.col("text").isNotNull(), T.blob_id(F.col("text"))))
        return replace(self, changes=self.changes.unionByName(made))

    def _with(self, rows: DataFrame) -> Vault:
        """The vault with more rows (path, op, text) in its last commit; they stay a plan."""
        last = self.changes.agg(F.max("seq").alias("seq")).join(self.changes, "seq").limit(1).select("seq", "author", "epoch", "message")
        made = rows.crossJoin(F.broadcast(last)).withColumn("new_path", F.lit(None).cast("string")).withColumn("revision", T.blob_id(F.col("text")))  # one row
        return replace(self, changes=self.changes.unionByName(made.select(self.changes.columns)))

    def _refused(self, path: str, content: str | None) -> Outcome | None:
        row = self.spark.createDataFrame([(path, content)], "p string, c string").select(filters.valid_path(F.col("p")), F.coalesce(scan.holds_secret(F.col("c")), F.lit(False))).first()
        return Outcome("bad_request", "path") if not row[0] else Outcome("blocked", "secret") if row[1] else None

    def write(self, path: str, content: str, expected: str | None = None, author: str = "agent", epoch: int | None = None) -> tuple[Outcome, Vault]:
        """Write if the note's revision is the expected one (null: it must not be there)."""
        if refused := self._refused(path, content):
            return refused, self
        held = self._held(path)
        if (held.revision if held else None) != expected:
            return Outcome("conflict", held.text if held else None, held.revision if held else None), self
        after = self._add([(path, "modify" if held else "add", None, content)], f"write: {path}", author, epoch)
        return Outcome("ok", revision=after._held(path).revision), after

    def edit(self, path: str, old: str, new: str, everywhere: bool = False, **more) -> tuple[Outcome, Vault]:
        held = self._held(path)
        if held is None:
            return Outcome("not_found"), self
        try:
            text = markdown.edit(held.text, old, new, everywhere)
        except ValueError as e:
            return Outcome("bad_request", str(e)), self
        return self.write(path, text, held.revision, **more)

    def delete(self, path: str, author: str = "agent", epoch: int | None = None) -> tuple[Outcome, Vault]:
        """Move a note to the trash, under a free name."""
        held = self._held(path)
        if held is None:
            return Outcome("not_found"), self
        taken = {r.path for r in history.snapshot(self.changes).where(F.col("path").startswith(filters.TRASH + path)).select("path").collect()}
        names = [filters.TRASH + path, *(f"{filters.TRASH}{path}.{i}" for i in range(1, len(taken) + 2))]
        to = next(n for n in names if n not in taken)
        return Outcome("ok"), self._add([(path, "delete", None, None), (to, "add", None, held.text)], f"delete: {path} -> {to}", author, epoch)

    def _trashed(self, trash_path: str):
        there = history.snapshot(self.changes).where(F.col("path") == trash_path)
        texts = self.changes.where("text is not null").groupBy("revision").agg(F.min("text").alias("text"))
        return there.join(texts, "revision").select("path", "text", "revision").first()

    def restore(self, trash_path: str, author: str = "agent", epoch: int | None = None) -> tuple[Outcome, Vault]:
        """Move a note back out of the trash to where its deletion took it from."""
        held = self._trashed(trash_path) if trash_path.startswith(filters.TRASH) else None
        if held is None:
            return Outcome("not_found"), self
        row = self.trash().where(F.col("trash_path") == trash_path).first()
        to = row.origin if row else trash_path.removeprefix(filters.TRASH)
        if (now := self._held(to)) is not None:
            return Outcome("conflict", now.text, now.revision), self
        return Outcome("ok", to, held.revision), self._add([(trash_path, "rename", to, held.text)], f"restore: {trash_path} -> {to}", author, epoch)

    def purge(self, trash_path: str, expected: str | None = None, author: str = "agent", epoch: int | None = None) -> tuple[Outcome, Vault]:
        """Take a note out of the trash for good; a revision that is given must be the held one."""
        if not trash_path.startswith(filters.TRASH):
            return Outcome("bad_request", "not in the trash"), self
        held = self._trashed(trash_path)
        if held is None:
            return Outcome("not_found"), self
        if expected is not None and expected != held.revision:
            return Outcome("conflict", held.text, held.revision), self
        return Outcome("ok", revision=held.revision), self._add([(trash_path, "delete", None, None)], f"purge: {trash_path}", author, epoch)

    def write_bytes(self, path: str, data: bytes, expected: str | None = None, author: str = "agent", epoch: int | None = None) -> tuple[Outcome, Vault]:
        """Write bytes as they are, unscanned; they must be UTF-8, since notes are kept as text.

        A conflict tells the held revision only.
        """
        if self.spark.createDataFrame([(path,)], "p string").where(~filters.valid_path(F.col("p"))).first():
            return Outcome("bad_request", "path"), self
        held = self._held(path)
        if (held.revision if held else None) != expected:
            return Outcome("conflict", None, held.revision if held else None), self
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            return Outcome("bad_request", "not UTF-8"), self
        after = self._add([(path, "modify" if held else "add", None, text)], f"write: {path}", author, epoch)
        return Outcome("ok", revision=after._held(path).revision), after

    def move(self, path: str, to: str, author: str = "agent", epoch: int | None = None) -> tuple[Outcome, Vault]:
        """Move a note and rewrite the links to it, in one commit."""
        if refused := self._refused(to, None):
            return refused, self
        held = self._held(path)
        if held is None or self._held(to) is not None:
            return Outcome("not_found" if held is None else "conflict"), self
        touching = self.resolved.where(F.col("resolved") == path).select(F.col("src").alias("path"), T.link_page(F.col("target")).alias("page")).distinct()
        bare = F.when(F.contains(F.col("page"), F.lit("/")), F.lit(to.removesuffix(".md"))).otherwise(F.lit(to.rsplit("/", 1)[-1].removesuffix(".md")))
        pages = touching.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("page", bare.alias("new")))).alias("pages")).join(self.snapshot(), "path")
        changed = pages.select("path", F.reduce("pages", F.col("text"), lambda text, p: links.rewritten(text, p["page"], p["new"])).alias("text"))
        own = changed.where(F.col("path") == path).select("text").first()  # a note may link to itself
        after = self._add([(path, "rename", to, own.text if own else held.text)], f"move: {path} -> {to}", author, epoch)
        return Outcome("ok"), after._with(changed.where(F.col("path") != path).withColumn("op", F.lit("modify")))

    def promote(self, path: str, to: str, **more) -> tuple[Outcome, Vault]:
        """Move a draft out of the drafts' folder."""
        if not path.startswith(filters.DRAFTS) or to.startswith(filters.DRAFTS):
            return Outcome("bad_request", "drafts only"), self
        return self.move(path, to, **more)

    def remember(self, content: str, kind: str = "fact", into: str = "memory", status: str | None = None, supersedes: str | None = None, adjudicate=None, subject: str | None = None, vector: list[float] | None = None, **more) -> tuple[Outcome, Vault]:
        """Keep a memory under a name made from its content; the same content is kept once.

        It is held against the nearest memories of its kind, by words and, if the vault has
        vectors and the memory's is given, by vectors; revoked and superseded ones and, if
        it has a subject, those of others do not count.

        `supersedes` names a note that the memory replaces: that is revoked and points to it.
        An uncertain match goes to `adjudicate(content, other)`, if there is one, which
        answers NEW, DUPLICATE, UPDATE or CONTRADICTION; contradicting memories are both
        kept, and the new one says so and waits for review.
        """
        path = self.spark.createDataFrame([(kind, content)], "k string, c string").select(T.memory_path(into, F.col("k"), F.col("c"))).first()[0]
        held = self._held(path)
        if held is not None:
            return Outcome("ok", "duplicate", held.revision), self
        if supersedes is not None and self._held(supersedes) is None:
            return Outcome("not_found", supersedes), self
        verdict, target = ("UPDATE", supersedes) if supersedes is not None else self._verdict(content, kind, path, subject, vector, adjudicate)
        if verdict == "DUPLICATE":
            return Outcome("ok", "duplicate of " + target), self
        lines = {"UNCERTAIN": "\nneeds-review: true", "CONTRADICTION": f"\nneeds-review: true\ncontradicts: {target}"}.get(verdict, "")
        about = "" if subject is None else "\nsubject: " + json.dumps(subject, ensure_ascii=False)
        state = status or ("provisional" if lines else "active")
        out, after = self.write(path, f"---\ntype: {kind}\nstatus: {state}{lines}{about}\n---\n{content.strip()}\n", None, **more)
        if out.status == "ok" and verdict == "UPDATE":
            old = after._held(target)
            text = markdown.patch_frontmatter(old.text, {"status": "revoked", "superseded_by": path})
            changed, later = after.write(target, text or f"---\nstatus: revoked\nsuperseded_by: {path}\n---\n{old.text}", old.revision, **more)
            after = later if changed.status == "ok" else after
        return (replace(out, detail=verdict.lower()) if out.status == "ok" else out), after

    def _verdict(self, content: str, kind: str, path: str, subject: str | None, vector: list[float] | None, adjudicate) -> tuple[str, str | None]:
        hits = self.search(content, "HYBRID", memory.CANDIDATES, filters.Filters(include_all=True, type=kind), vector).groupBy("path").agg(F.min(F.coalesce("rank", F.lit(1))).alias("rank"))
        near = hits.join(self.snapshot().select("path", markdown_body().alias("other")), "path").join(self.parsed.select("path", "status", "superseded_by", "subject"), "path")
        near = near.withColumnRenamed("path", "target").withColumn("id", F.lit("x"))
        asked = self.spark.createDataFrame([("x", content, subject, path)], "id string, body string, subject string, path string")
        if vector is not None and self.vectors is not None:
            means = search.mean_vectors(self.chunks.select("path", "content_hash").join(self.vectors, "content_hash"))
            near = near.join(means.select(F.col("path").alias("target"), F.col("vec").alias("other_vec")), "target", "left")
            asked = asked.withColumn("vec", F.array(*map(F.lit, vector)))
        found = memory.classify(asked, near).first()
        if found.verdict != "UNCERTAIN" or adjudicate is None:
            return found.verdict, found.target
        other = self.snapshot().where(F.col("path") == found.target).select(markdown_body()).first()[0]
        answer = adjudicate(content, other)
        return (answer if answer in ("NEW", "DUPLICATE", "UPDATE", "CONTRADICTION") else "UNCERTAIN"), found.target

    def extract_memories(self, transcript: str, extractor=None, most: int = 10, **more) -> tuple[Outcome, Vault]:
        """Provisional memories from a transcript by a pluggable extractor (text to list of texts or null)."""
        if len(transcript) > 20_000:
            return Outcome("bad_request", "too long"), self
        if refused := self._refused("x.md", transcript):
            return refused, self
        if extractor is None:
            return Outcome("not_configured"), self
        after, kept = self, 0
        for text in (extractor(transcript) or [])[: min(max(most, 1), 20)]:
            out, after = after.remember(text, status="provisional", **more)
            kept += out.status == "ok"
        return Outcome("ok", str(kept)), after


def markdown_body():
    """A note's text without its frontmatter."""
    return F.regexp_replace("text", r"(?s)\A﻿?---\r?\n.*?\r?\n---[ \t]*(\r?\n|\z)", "")
