"""Substring dedup: passages of many words that an earlier document has are removed.

A window is thirteen neighbouring words.  Windows are not shuffled one by one.  Each has
an anchor, the least hash of the six-word runs in it; windows in a row with one anchor
form an excerpt.  Equal windows have equal anchors, so:

1. Anchors that occur in one document only are dropped, with all their windows.
2. Of the excerpts left, equal ones (key: anchor and excerpt hash, 128 bits) are
   confirmed as recurring passages; the smallest doc_id with them is their source.
3. Only anchors with several different excerpts, at the edges of passages, are looked at
   window by window, and only in each excerpt's source.
4. Every shard of documents gets the confirmed passages that occur in it, each once
   however many of its documents hold it, compiles them into an Aho-Corasick automaton
   over word numbers, and streams its documents through it.  Every occurrence is found
   word by word; it goes if the passage's source is a smaller document.

Groups by anchor are never gathered: they are aggregated (map side first) and joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import bytetext as bt
from loomnote.llm.shared import Tables

WINDOW = 13
ANCHOR = 6
SHARD_BYTES = 2 << 20


class Excerpts:
    """The windows of a chunk's documents, grouped into runs with one anchor."""

    def __init__(self, chunk: bt.Chunk):
        self.words = bt.words(chunk, bt.NON_SPACE)
        self.hashes = bt.span_hash(chunk.data, self.words.start, self.words.end)
        reach = WINDOW - ANCHOR + 1
        least = bt.run_hash(self.hashes, ANCHOR)
        done = 1
        while done < reach:
            step = min(done, reach - done)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            done += step
        starts = np.flatnonzero(self.words.left()[: len(least)] >= WINDOW)
        anchor = least[starts]
        row = self.words.owner()[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        #: Of each excerpt: its first window's word, its number of windows, document, anchor.
        self.first = starts[head]
        self.count = np.diff(np.append(head, len(starts)))
        self.row, self.anchor = row[head], anchor[head]
        #: A hash of all the words from the first window's start to the last one's end.
        value = bt.Sums(self.hashes).spans(self.first, self.first + self.count + WINDOW - 1)
        self.key = bt.mix(value + self.count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some excerpts every window: its excerpt, first word and hash."""
        count = self.count[chosen]
        which = np.repeat(chosen, count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[which]
        key = np.zeros(len(start), np.uint64)
        factor = 1
        for i in range(WINDOW):
            factor = factor * 0x94D049BB133111EB & (1 << 64) - 1 | 1
            key += self.hashes[start + i] * np.uint64(factor)
        return which, start, bt.mix(key)


def _list(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    offsets = np.searchsorted(row, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in bt.chunks(batch.column("text")):
            found = Excerpts(chunk)
            size = np.diff(chunk.starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first, chunk.rows), pa.array(size), _list(found.anchor, found.row, chunk.rows), _list(found.key, found.row, chunk.rows)],
                names=["doc_id", "bytes", "anchors", "keys"],
            )


def _edge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of those excerpts that a document's list `wanted` names."""
    for batch in batches:
        wanted = batch.column("wanted")
        for chunk in bt.chunks(batch.column("text")):
            found = Excerpts(chunk)
            named = wanted.slice(chunk.first, chunk.rows)
            keys = np.asarray(named.flatten()).view(np.uint64)
            rows = np.repeat(np.arange(chunk.rows), np.asarray(named.value_lengths()))
            both = np.rec.fromarrays([np.concatenate([rows, found.row]), np.concatenate([keys, found.key])])
            _, code = np.unique(both, return_inverse=True)
            chosen = np.flatnonzero(np.isin(code[len(rows) :], code[: len(rows)]))
            which, _, key = found.windows(chosen)
            ids = batch.column("doc_id").take(pa.array(chunk.first + found.row[which]))
            yield pa.RecordBatch.from_arrays([pa.array(found.anchor[which].view(np.int64)), pa.array(key.view(np.int64)), ids], names=["anchor", "key", "doc_id"])


STREAM_WORDS = 100_000


class Automaton:
    """Aho-Corasick over word numbers.

    A number becomes two letters of two alphabets of some square root's size each, since the
    automaton looks through a state's followers one by one.  Number 0 is in no pattern.
    """

    def __init__(self, patterns: dict[tuple[int, ...], int], vocabulary: int):
        self.base = int(np.ceil(np.sqrt(vocabulary + 1))) + 1
        self.held = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.length = np.fromiter(map(len, patterns), np.int64, len(patterns))
        self.source = np.fromiter(patterns.values(), np.int64, len(patterns))
        letters = self._letters(np.fromiter((w for p in patterns for w in p), np.int64, int(self.length.sum())))
        ends = (2 * np.cumsum(self.length)).tolist()
        at = 0
        for number, end in enumerate(ends):
            self.held.add_word(tuple(letters[at:end]), number)
            at = end
        self.held.make_automaton()

    def _letters(self, numbers: np.ndarray) -> list[int]:
        return np.stack([numbers // self.base + self.base, numbers % self.base], axis=1).ravel().tolist()

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End (exclusive) and pattern of every occurrence."""
        hits = np.array(list(self.held.iter(tuple(self._letters(numbers)))), np.int64).reshape(-1, 2)
        return hits[:, 0] // 2 + 1, hits[:, 1]


def _spell(found: Excerpts, kind: np.ndarray, anchor: np.ndarray, key: np.ndarray, lo: np.ndarray) -> list[tuple[int, int, int]]:
    """First word, number of words and source of each passage, as it stands in these documents."""
    spelled: list[tuple[int, int, int]] = []
    windows = np.unique(anchor[kind == 1])
    which, start, window_key = found.windows(np.flatnonzero(np.isin(found.anchor, windows)))
    for number, keys, anchors, first, length in (
        (0, found.key, found.anchor, found.first, found.count + WINDOW - 1),
        (1, window_key, found.anchor[which], start, np.full(len(start), WINDOW)),
    ):
        own = kind == number
        k, a, least = key[own], anchor[own], lo[own]
        if not len(k) or not len(keys):
            continue
        order = np.argsort(k, kind="stable")
        k, a, least = k[order], a[order], least[order]
        _, once = np.unique(keys, return_index=True)
        place = np.minimum(np.searchsorted(k, keys[once]), len(k) - 1)
        good = (k[place] == keys[once]) & (a[place] == anchors[once])
        spelled += zip(first[once][good].tolist(), length[once][good].tolist(), least[place][good].tolist(), strict=True)
    return spelled


def _marks(found: Excerpts, ids: np.ndarray, patterns: tuple[np.ndarray, ...]) -> np.ndarray:
    """True for every word inside a passage whose source is a smaller document."""
    changes = np.zeros(len(found.hashes) + 1, np.int32)
    spelled = _spell(found, *patterns) if len(patterns[0]) and len(found.first) else []
    if spelled:
        first, length, _ = (np.array(x, np.int64) for x in zip(*spelled, strict=True))
        inside = np.zeros(len(found.hashes) + 1, np.int32)
        np.add.at(inside, first, 1)
        np.add.at(inside, first + length, -1)
        vocabulary = np.unique(found.hashes[np.cumsum(inside[:-1]) > 0])
        place = np.minimum(np.searchsorted(vocabulary, found.hashes), len(vocabulary) - 1)
        number = np.where(vocabulary[place] == found.hashes, place + 1, 0)
        sequences: dict[tuple[int, ...], int] = {}
        flat = number.tolist()
        for start, size, least in spelled:
            word = tuple(flat[start : start + size])
            sequences[word] = min(least, sequences.get(word, least))
        automaton = Automaton(sequences, len(vocabulary))
        bounds, row = found.words.row, 0
        while row < len(bounds) - 1:
            stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STREAM_WORDS, "right")) - 1)
            begin, count = bounds[row], np.diff(bounds[row : stop + 1])
            stream = np.zeros(int(count.sum()) + stop - row, np.int64)
            shift = np.repeat(np.arange(stop - row), count)
            stream[np.arange(len(shift)) + shift] = number[begin : bounds[stop]]
            end, value = automaton.find(stream)
            # a stream position counts one break after each document before it
            own = np.searchsorted(np.cumsum(count + 1), end - 1, "right")
            good = automaton.source[value] < ids[row + own]
            end = (end - own + begin)[good]
            np.add.at(changes, end - automaton.length[value[good]], 1)
            np.add.at(changes, end, -1)
            row = stop
    return np.cumsum(changes[:-1]) > 0


def _remove(docs: pa.Table, patterns: pa.Table) -> pa.Table:
    """One shard: spell its passages, compile the automaton, stream every document."""
    ids = np.asarray(docs.column("doc_id").combine_chunks().fill_null(-(1 << 63)))
    columns = [np.asarray(patterns.column(n).combine_chunks()) if len(patterns) else np.zeros(0, np.int64) for n in ("kind", "anchor", "key", "lo")]
    columns[1], columns[2] = columns[1].view(np.uint64), columns[2].view(np.uint64)
    texts = docs.column("text")
    kept, total, gone = [], [], []
    texts = pa.concat_arrays(texts.chunks) if texts.num_chunks != 1 else texts.chunk(0)
    for chunk in bt.chunks(texts, 1 << 40):
        found = Excerpts(chunk)
        stay = ~_marks(found, ids[chunk.first : chunk.first + chunk.rows], tuple(columns))
        data, bounds, cut = chunk.data.tobytes(), found.words.row.tolist(), chunk.starts.tolist()
        for r in range(chunk.rows):
            words = data[cut[r] : cut[r + 1]].split()
            own = stay[bounds[r] : bounds[r + 1]]
            n = int(np.count_nonzero(own))
            kept.append(b" ".join(words if n == len(words) else compress(words, own.tolist())))
            total.append(len(words))
            gone.append(len(words) - n)
    return pa.table([docs.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words left, joined by one blank).

    Null texts have no words.  A document with a null doc_id is neither source nor
    searched; rows that share a doc_id do not count as each other's sources.  Other
    columns are ignored.
    """
    tables = Tables(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    anchors = tables.write(texts.mapInArrow(_anchors, "doc_id long, bytes long, anchors array<long>, keys array<long>"), "anchors")
    size = anchors.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    each = anchors.where("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("anchors", "keys")).alias("e")).select("doc_id", F.col("e.anchors").alias("anchor"), F.col("e.keys").alias("key"))
    common = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    common = tables.write(common, "common")
    found = tables.write(each.join(common, "anchor"), "found")
    tables.drop("anchors")
    sources = tables.write(found.groupBy("anchor", "key").agg(F.min("doc_id").alias("lo")), "sources")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    whole = found.join(sources, ["anchor", "key"]).where("lo < doc_id").select(shard, F.lit(0).cast("long").alias("kind"), "anchor", "key", "lo").distinct()
    several = sources.groupBy("anchor").agg(F.count("key").alias("n")).where("n > 1").select("anchor")
    edges = sources.join(several, "anchor").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list("key").alias("wanted"))
    windows = texts.join(edges, "doc_id").mapInArrow(_edge_windows, "anchor long, key long, doc_id long")
    windows = tables.write(windows.distinct(), "windows")
    least = windows.groupBy("anchor", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    parts = windows.join(least, ["anchor", "key"]).where("lo < doc_id").select(shard, F.lit(1).cast("long").alias("kind"), "anchor", "key", "lo").distinct()
    passages = tables.finish(whole.unionAll(parts))
    # a document without an id has no passages to meet, so its text deals it
    dealt = texts.withColumn("shard", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(shards)))
    return dealt.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")
