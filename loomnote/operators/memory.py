"""Typed memories: duplicates, classification, review, sessions, proposals, dashboard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomnote.functions import text as T
from loomnote.operators.filters import awaiting_review, current
from loomnote.operators.order import cut, numbered

#: The ladders for vectors and for words, and listing limits.
SAME_COSINE, CLOSE_COSINE, SAME_WORDS, CLOSE_WORDS = 0.97, 0.82, 0.90, 0.35
CANDIDATES = 5
#: So many words' frequencies, and so many paths, are sent to every task at most.
FREQUENT = 100_000
#: Overlaps from which equal parts find near sets: their parts hold five words and more; below, rare words do.
PARTS_FROM = 0.85
#: So many words are parted at once, and so many numbers of paths sent to every task at most.
PART_WORDS, ASKED = 1_000_000, 1_000_000
REVIEW_LIMIT, RULES_LIMIT = 200, 40
TYPES = ("fact", "preference", "policy", "episode")


def near_words(notes: DataFrame, minimum: float = CLOSE_WORDS) -> DataFrame:
    """a, b (a < b), overlap: notes of one type whose word sets overlap at least so much.

    Exact.  Equal sets (by SHA-256) are compared once, for all notes that have them; how sets
    that may overlap so much are found depends on `minimum` (PARTS_FROM).
    """
    keyed, scored = _by_parts(notes, minimum) if minimum >= PARTS_FROM else _by_first_words(notes, minimum)
    x, y = keyed.select(F.col("path").alias("x"), F.col("key").alias("a")), keyed.select(F.col("path").alias("y"), F.col("key").alias("b"))
    between = scored.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")
    within = x.join(y, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("overlap"))
    return between.unionAll(within)


def _sets(notes: DataFrame) -> DataFrame:
    """path, type, w, key: the notes' words and the digest of words and type.

    The key is never null and empty sets stay: a filter on either would be pushed down to
    the notes, and their words be taken twice.
    """
    sets = notes.where("path is not null and type is not null").select("path", "type", F.array_distinct(T.words(F.col("text"))).alias("w"))
    # words hold no line feed, so the first one ends them
    key = F.unhex(F.sha2(F.concat_ws("\n", F.array_join(F.sort_array("w"), " "), "type"), 256))
    return sets.withColumn("key", F.coalesce(key, F.lit(bytearray())))


def _overlap(minimum: float) -> tuple[Column, Column]:
    """The overlap of the sets wa and wb, and whether it and their sizes reach the minimum."""
    both, na, nb = F.size(F.array_intersect("wa", "wb")), F.size("wa"), F.size("wb")
    value = F.round(both / (na + nb - both), 6)
    return value, (F.least(na, nb) >= F.greatest(na, nb) * minimum) & (value >= minimum)


def _by_parts(notes: DataFrame, minimum: float) -> tuple[DataFrame, DataFrame]:
    """path, key of every set that is not empty; a, b (keys), overlap of the different sets that overlap so much.

    Sets of at most r words that overlap so much differ in at most d words, d the share
    (1 - minimum) / (1 + minimum) of 2 r.  Words are dealt by their hash to d + 1 parts, so one
    part at least is equal in both.  Sizes are cut into ranges so wide that the smaller set lies
    in the range of the larger or in the next below; a set gives its parts by the bounds of its
    own range and of the next above.  Hashes of parts are all that is shuffled for every note:
    no pair is made but of sets with an equal part.

    Each pair meets at the least part that it shares, so that a group of near copies sends its
    words to a few places, once a note and not once a pair.
    """
    least = minimum - 1e-6  # the overlap is rounded
    share = (1 - least) / (1 + least)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pc.greater(pc.list_value_length(whole.column("h")), 0))
            every = batch.column("h").offsets.to_numpy()
            at = 0
            while at < len(batch):  # so many words at once
                to = max(at + 1, int(np.searchsorted(every, every[at] + PART_WORDS, side="right")) - 1)
                yield _parts(batch.slice(at, min(to, len(batch)) - at), least, share)
                at = to

    hashes = _sets(notes).select("path", "key", F.xxhash64("type").alias("kind"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    made = cut(hashes.mapInArrow(parted, "path string, key binary, own int, parts array<long>"))
    keyed = made.select("path", "key")
    # by a number for the key; copies fall together
    each = made.select(F.xxhash64("key").alias("k"), "own", F.posexplode("parts").alias("place", "part")).select("part", "k", (F.col("place") < F.col("own")).alias("own"))
    each = each.repartition("part").distinct()
    one, two = each.select("part", F.col("k").alias("a"), F.col("own").alias("oa")), each.select("part", F.col("k").alias("b"), F.col("own").alias("ob"))
    pairs = cut(one.join(two, "part").where("a < b and (oa or ob)").groupBy("a", "b").agg(F.min("part").alias("part")))
    meets = pairs.select("a", "part").unionAll(pairs.select("b", "part")).groupBy(F.col("a").alias("k")).agg(F.collect_set("part").alias("meets"))
    asked = cut(keyed.groupBy("key").agg(F.min("path").alias("first")).withColumn("k", F.xxhash64("key")).join(meets, "k").select("key", "first", "meets"))
    few = asked.select(F.xxhash64("first").alias("__number")).distinct()
    some = notes.join(F.broadcast(few), F.xxhash64("path") == F.col("__number"), "left_semi") if few.count() <= ASKED else notes  # others' words are neither taken nor shuffled
    held = _sets(some).join(asked.withColumnRenamed("first", "path"), ["key", "path"]).select("key", "w", "meets", F.explode("meets").alias("part"))
    left = held.select("part", F.col("key").alias("a"), F.col("w").alias("wa"), F.col("meets").alias("ma"))
    right = held.select("part", F.col("key").alias("b"), F.col("w").alias("wb"), F.col("meets").alias("mb"))
    value, enough = _overlap(minimum)
    once = left.join(right, "part").where((F.col("a") < F.col("b")) & (F.array_min(F.array_intersect("ma", "mb")) == F.col("part")))
    return keyed, cut(once.where(enough).select("a", "b", value.alias("overlap")).distinct())  # a note may stand twice


def _parts(rows: pa.RecordBatch, least: float, share: float) -> pa.RecordBatch:
    """path, key, own, parts: hashes of a set's parts, `own` of them by its own range of sizes, the others by the next."""
    column = rows.column("h")
    offsets = column.offsets.to_numpy().astype(np.int64)
    words = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    kinds = rows.column("kind").to_numpy(zero_copy_only=False).view(np.uint64)
    sizes, row = np.diff(offsets), np.repeat(np.arange(len(rows)), np.diff(offsets))
    from_ = [1]
    while from_[-1] <= sizes.max() or len(from_) < 3:
        from_.append(int(from_[-1] / least) + 1)
    from_.append(int(from_[-1] / least) + 1)
    bounds = np.array(from_)
    level = np.searchsorted(bounds, sizes, side="right") - 1
    levels = np.stack([level, level + 1], axis=1).ravel()  # a row's own range, then the next
    counts = np.floor(share * 2 * (bounds[levels + 1] - 1)).astype(np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(counts)])
    sums = np.zeros(starts[-1], np.uint64)
    mixed = _mixed(words)
    for turn in (0, 1):
        at = 2 * row + turn
        np.add.at(sums, starts[at] + ((words >> np.uint64(7)) % counts[at].astype(np.uint64)).astype(np.int64), mixed)
    of = np.repeat(np.arange(len(levels)), counts)
    place = (np.arange(starts[-1]) - starts[of]).astype(np.uint64)
    parts = _mixed(sums ^ _mixed(kinds[of // 2] ^ _mixed((levels[of].astype(np.uint64) << np.uint64(40)) + place)))
    lists = pa.ListArray.from_arrays(pa.array(starts[::2].astype(np.int32)), pa.array(parts.view(np.int64)))
    return pa.RecordBatch.from_arrays([rows.column("path"), rows.column("key"), pa.array(counts[::2].astype(np.int32)), lists], names=["path", "key", "own", "parts"])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose bits all depend on all bits of the given ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _by_first_words(notes: DataFrame, minimum: float) -> tuple[DataFrame, DataFrame]:
    """path, key of every set that is not empty; a, b (keys), overlap of the different sets that overlap so much.

    By prefix filtering: sets that overlap by `minimum` share one of the first words of both
    in any one order, here the least frequent first (of words beyond the FREQUENT most
    frequent ones: by the word alone).  Prefixes are taken in the tasks that read the notes.
    """
    sets = _sets(notes).where(F.size("w") > 0)
    keyed = cut(sets.select("path", "key"))
    often = sets.select("type", F.explode("w").alias("word")).groupBy("type", "word").agg(F.count("*").alias("df")).where("df > 1")
    common: dict[str, dict[str, int]] = {}
    for r in often.orderBy(F.desc("df"), "type", "word").limit(FREQUENT).collect():
        common.setdefault(r.type, {})[r.word] = r.df
    known_words = sets.sparkSession.sparkContext.broadcast(common)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words.value
        for batch in batches:
            out: list[tuple] = []
            for path, kind, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, own = len(words), known.get(kind, {})
                words.sort()
                words.sort(key=lambda w: own.get(w, 0))  # noqa: B023
                out += [(kind, w, path, n, i) for i, w in enumerate(words[: n - math.ceil(n * minimum) + 1])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["type", "word", "path", "n", "place"])

    first = cut(keyed.groupBy("key").agg(F.min("path").alias("path")))
    head = cut(sets.select("path", "type", "w").mapInArrow(heads, "type string, word string, path string, n int, place int").join(first, "path", "left_semi"))
    one = head.select("type", "word", F.col("path").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    two = head.select("type", "word", F.col("path").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * minimum)
    # what both can still share from their first common word on
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (1 + minimum) >= (F.col("na") + F.col("nb")) * (minimum - 1e-6)
    pairs = cut(one.join(two, ["type", "word"]).where(fits & rest).select("a", "b").distinct())
    ids = cut(pairs.select(F.col("a").alias("path")).unionAll(pairs.select("b")).distinct())
    few = F.broadcast(ids) if ids.count() <= FREQUENT else ids  # others' sets are not shuffled
    asked = sets.join(few, "path", "left_semi")
    left, right = asked.select(F.col("path").alias("a"), F.col("key").alias("ka"), F.col("w").alias("wa")), asked.select(F.col("path").alias("b"), F.col("key").alias("kb"), F.col("w").alias("wb"))
    value, enough = _overlap(minimum)
    return keyed, pairs.join(left, "a").join(right, "b").where(enough).select(F.col("ka").alias("a"), F.col("kb").alias("b"), value.alias("overlap"))


def comparable(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that an incoming memory can be held against.

    Of the best CANDIDATES, those that are neither revoked nor superseded, are not the place
    where the memory itself would go (`path` of incoming), and share its subject, if it has
    one; case does not count.  Columns that either side lacks rule nothing out.
    """
    rows = candidates.where(F.col("rank") <= CANDIDATES)
    if "status" in rows.columns:
        rows = rows.where(F.coalesce("status", F.lit("")) != "revoked")
    if "superseded_by" in rows.columns:
        rows = rows.where("superseded_by is null")
    asked = incoming.select("id", *(F.col(c).alias(f"asked_{c}") for c in ("subject", "path") if c in incoming.columns))
    rows = rows.join(asked, "id")
    if "path" in incoming.columns:
        rows = rows.where(~F.col("target").eqNullSafe(F.col("asked_path")))
    if "subject" in incoming.columns and "subject" in candidates.columns:
        rows = rows.where(F.col("asked_subject").isNull() | (F.lower(F.coalesce("subject", F.lit(""))) == F.lower("asked_subject")))
    return rows.drop("asked_subject", "asked_path", "subject", "status", "superseded_by")


def classify(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, verdict, confidence, target: what each incoming memory is, given its candidates.

    incoming: id, body (, vec, subject, path).  candidates: id, target, other, rank
    (, other_vec, status, superseded_by, subject); only `comparable` ones count.  Equal
    normalised bodies are duplicates; then the cosine ladder where both have vectors, else
    the word ladder.  Ambiguous ones are UNCERTAIN for an adjudicator to settle.
    """
    pairs = incoming.drop("subject", "path").join(comparable(incoming, candidates), "id", "left")
    same = T.normalised(F.col("body")) == T.normalised(F.col("other"))
    vectors = "vec" in incoming.columns and "other_vec" in candidates.columns
    words = T.jaccard(F.array_distinct(T.words(F.col("body"))), F.array_distinct(T.words(F.col("other"))))
    have = (F.col("vec").isNotNull() & F.col("other_vec").isNotNull()) if vectors else F.lit(False)
    near = F.when(have, T.cosine(F.col("vec"), F.col("other_vec"))).otherwise(words) if vectors else words
    high, low = F.when(have, SAME_COSINE).otherwise(SAME_WORDS), F.when(have, CLOSE_COSINE).otherwise(CLOSE_WORDS)
    score = F.when(F.col("target").isNull(), 0.0).when(same, 1.0).otherwise(F.round(near, 6))
    ranked = pairs.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("score", score).withColumn("high", high).withColumn("low", low)
    order = Window.partitionBy("id").orderBy(F.desc("same"), F.desc("score"), "target")
    best = ranked.withColumn("turn", F.row_number().over(order)).where("turn = 1")
    verdict = F.when(F.col("target").isNull(), "NEW").when(F.col("same") | (F.col("score") >= F.col("high")), "DUPLICATE").when(F.col("score") >= F.col("low"), "UNCERTAIN").otherwise("NEW")
    out = best.withColumn("verdict", verdict)
    return out.select("id", "verdict", F.round(F.when(F.col("verdict") == "NEW", 1 - F.col("score")).otherwise(F.col("score")), 6).alias("confidence"), F.when(F.col("verdict") != "NEW", F.col("target")).alias("target"))


def review_queue(notes: DataFrame, now: int, limit: int = REVIEW_LIMIT) -> DataFrame:
    """place, path: what waits for review: flagged or contradicting first, then newest, then by path."""
    urgent = F.coalesce(F.col("needs_review"), F.lit(False)) | F.col("contradicts").isNotNull()
    rows = notes.where(awaiting_review(now)).select("path", urgent.alias("urgent"), "created")
    rows = rows.orderBy(F.desc("urgent"), F.desc_nulls_last("created"), "path").limit(limit)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("urgent"), F.desc_nulls_last("created"), "path")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select("place", "path", "urgent")


def rulebook(notes: DataFrame, now: int, types: tuple[str, ...] = ("policy", "preference"), limit: int = RULES_LIMIT) -> DataFrame:
    """place, path, type: active rules by type, title, path."""
    rows = notes.where(F.col("type").isin(*types) & ~F.coalesce("status", F.lit("")).isin("revoked", "provisional") & current(now))
    rows = rows.select("path", "type", F.lower("title").alias("t")).orderBy("type", "t", "path").limit(limit)
    order = Window.partitionBy(F.lit(0)).orderBy("type", "t", "path")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select("place", "path", "type")


def capture(captures: DataFrame) -> DataFrame:
    """session_id, bytes, started_at, ended_at: the largest transcript of each session and its first start."""
    best = F.max_by(F.struct("bytes", "ended_at"), F.struct("bytes", "ended_at"))
    return captures.groupBy("session_id").agg(best.alias("b"), F.min("started_at").alias("started_at")).select("session_id", "b.bytes", "started_at", "b.ended_at")


def list_sessions(sessions: DataFrame, distilled: bool | None = None, limit: int | None = None) -> DataFrame:
    """Sessions with their place, the last ended first; of one kind and at most `limit`, if that is given."""
    rows = sessions if distilled is None else sessions.where(F.col("distilled") == distilled)
    if limit is None:
        return numbered(rows, "place", F.desc("ended_at"), "session_id").withColumn("place", F.col("place") + 1)
    rows = rows.orderBy(F.desc("ended_at"), "session_id").limit(limit)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("ended_at"), "session_id")  # `limit` rows
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def _unadorned(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s*_`\"']+|[\s*_`\"']+$", "")


def parsed_summaries(answers: DataFrame) -> DataFrame:
    """id, title, summary of a model's answers (id, raw): what follows the labels, without Markdown around it.

    Without a SUMMARY label the whole answer is the summary; without a TITLE there is none.
    """
    title = _unadorned(F.regexp_extract("raw", r"(?im)^[^\p{L}\p{N}\n]{0,4}TITLE\s*:\s*(.+)$", 1))
    body = _unadorned(F.regexp_extract("raw", r"(?ims)^[^\p{L}\p{N}\n]{0,4}SUMMARY\s*:\s*(.+)$", 1))
    return answers.select("id", F.when(title != "", title).alias("title"), F.when(body != "", body).otherwise(F.trim("raw")).alias("summary"))


def parse_candidates(raw: str, most: int = 10) -> list[dict] | None:
    """Memories (content, type, subject) in a model's answer: its first JSON array that can be read, or null."""
    import json
    import re

    text = re.sub(r"```[a-zA-Z]*", "", raw)
    end, start, found = text.rfind("]"), text.find("["), None
    while found is None and 0 <= start < end:
        try:
            found = json.loads(text[start : end + 1])
        except ValueError:
            start = text.find("[", start + 1)
    if not isinstance(found, list):
        return None
    out = []
    for item in found:
        content = item.get("content") if isinstance(item, dict) else None
        if isinstance(content, str) and content.strip():
            kind, subject = (str(item.get(k) or "").strip() for k in ("type", "subject"))
            out.append({"content": content.strip(), "type": kind.lower() if kind.lower() in TYPES else "fact", "subject": subject or None})
    return out[: max(most, 0)]


def decided(open_proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with the status that a decision (id, decision: accept or reject) gives open ones."""
    state = F.when(F.col("status") == "open", F.when(F.col("decision") == "accept", "accepted").when(F.col("decision") == "reject", "rejected"))
    return open_proposals.join(decisions, "id", "left").withColumn("status", F.coalesce(state, "status")).drop("decision")


def proposals(rows: DataFrame) -> DataFrame:
    """The first proposal (by seq) of each kind, title and scope, with its id."""
    made = F.substring(F.sha2(F.concat_ws("|", "kind", "title", "scope"), 256), 1, 16)
    first = rows.withColumn("id", made).groupBy("id").agg(F.min_by(F.struct("kind", "title", "scope", "seq"), "seq").alias("p"))
    return first.select("id", "p.kind", "p.title", "p.scope", "p.seq")


def dashboard(sessions: DataFrame, open_proposals: DataFrame, notes: DataFrame, now: int) -> DataFrame:
    """One row of counts: sessions, bytes captured and distilled, their ratio, open work."""
    a = sessions.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("captured"), F.coalesce(F.sum(F.when(F.col("distilled"), F.col("bytes"))), F.lit(0)).alias("distilled"))
    b = open_proposals.agg(F.count("*").alias("open_proposals"))
    c = notes.where(awaiting_review(now)).agg(F.count("*").alias("awaiting_review"))
    return a.crossJoin(b).crossJoin(c).withColumn("ratio", F.round(F.col("captured") / F.greatest("distilled", F.lit(1)), 6))


def remember(requests: DataFrame, notes: DataFrame, folder: str = "memory") -> DataFrame:
    """id, path, outcome: where a memory would go; DEDUP if a note is there, UPDATE if it supersedes, else NEW."""
    rows = requests.withColumn("path", T.memory_path(folder, F.col("type"), F.col("content")))
    there = notes.select("path", F.lit(True).alias("there")).distinct()
    return rows.join(there, "path", "left").select("id", "path", F.when(F.col("there"), "DEDUP").when(F.col("supersedes").isNotNull(), "UPDATE").otherwise("NEW").alias("outcome"))


def reviewed(notes: DataFrame, decisions: DataFrame) -> DataFrame:
    """path, status: states after review (decisions: path, decision approve, decline or reopen)."""
    state = F.when(F.col("decision") == "approve", "active").when(F.col("decision") == "decline", "revoked").when(F.col("decision") == "reopen", "provisional")
    return notes.select("path", "status").join(decisions, "path", "left").select("path", F.coalesce(state, "status").alias("status"))
