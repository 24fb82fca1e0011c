"""Periodic runs of words: stretches that repeat a shorter stretch at least twice.

Karp, Miller and Rosenberg's naming gives every stretch of 2^k words a number, the same
for equal stretches of one document: level 0 numbers words, level k + 1 numbers pairs of
level k.  A stretch that no other place of its document equals needs no further name.
The common length of the words from two places on (or backwards) is found by descending
the levels.

A run with period p and length n >= 2 p holds n - p >= p neighbouring places i with equal
words at i and i + p, so one of every p places on a grid is among them; for short periods
the least length makes the grid coarser.  Each grid candidate whose two words are equal is
extended both ways by common lengths.  If it lies within a run already found whose
period divides p, it would give that run again and is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import bytetext as bt
from loomnote.llm.shared import small_batches

MIN_LENGTH = 12
#: Grid candidates, of one period or several, that are extended together.
TOGETHER = 20_000


def _numbered(values: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the values that occur several times, 0 for the others."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    alone = new.copy()
    alone[:-1] &= new[1:]
    name = np.cumsum(new & ~alone)
    out = np.zeros(len(values), np.int64)
    out[order] = np.where(alone, 0, name)
    return out


class Names:
    """Names of the stretches of 2^k words; 0 where no other place of the document has the same."""

    def __init__(self, words: np.ndarray, row: np.ndarray):
        """`words`: numbers below 2^31, equal for equal words; `row`: each word's document, ascending."""
        self.size = len(words)
        level = _numbered(row << 32 | words)
        self.levels = [level.astype(np.int32)]
        self.places = np.flatnonzero(level)
        places, names = self.places, level[self.places]
        step = 1
        while len(places):
            # pairs of named stretches side by side; a stretch that goes past its document's end has no name
            after = places + step
            good = after < self.size
            second = np.zeros(len(places), np.int64)
            second[good] = self.levels[-1][after[good]]
            good &= second > 0
            good[good] &= row[places[good]] == row[np.minimum(after[good] + step - 1, self.size - 1)]
            places = places[good]
            named = _numbered(names[good] << 32 | second[good])
            places, names = places[named > 0], named[named > 0]
            if not len(places):
                break
            level = np.zeros(self.size, np.int32)
            level[places] = names
            self.levels.append(level)
            step *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name = self.levels[k]
            # a name may match twice at the top level only, until no more of it is there
            while True:
                inside = np.flatnonzero(np.maximum(i, j) + (1 << k) <= self.size)
                same = inside[(name[i[inside]] > 0) & (name[i[inside]] == name[j[inside]])]
                i[same] += 1 << k
                j[same] += 1 << k
                length[same] += 1 << k
                if k < len(self.levels) - 1 or not len(same):
                    break
        return length

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name = self.levels[k]
            while True:
                inside = np.flatnonzero(np.minimum(i, j) >= 1 << k)
                a, b = name[i[inside] - (1 << k)], name[j[inside] - (1 << k)]
                same = inside[(a > 0) & (a == b)]
                i[same] -= 1 << k
                j[same] -= 1 << k
                length[same] += 1 << k
                if k < len(self.levels) - 1 or not len(same):
                    break
        return length


def find(words: np.ndarray, sizes: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run, for documents one after the other.

    `words` are numbers below 2^31, `sizes` the documents' numbers of words.  A run has
    `least` words and twice its period at least, lies in one document, and cannot be made
    longer.  Sorted by start, then period.
    """
    order = np.argsort(-sizes, kind="stable")  # long documents first: fewer remain for each longer period
    begin = np.cumsum(sizes) - sizes
    ahead = np.cumsum(sizes[order]) - sizes[order]
    at = np.repeat(begin[order] - ahead, sizes[order]) + np.arange(len(words))
    words, row = words[at].astype(np.int64), np.repeat(np.arange(len(sizes)), sizes[order])
    names = Names(words, row)
    level = names.levels[0]
    descending = sizes[order]
    starts, ends, periods = ([np.zeros(0, np.int64)] for _ in range(3))
    #: Of one run found over each place: its period and end.
    period_of, end_of = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def extend() -> None:
        i, p = (np.concatenate(x) for x in zip(*waiting, strict=True))
        known = np.flatnonzero(period_of[i] > 0)
        known = known[(p[known] % period_of[i[known]] == 0) & (i[known] + p[known] < end_of[i[known]])]
        i, p = np.delete(i, known), np.delete(p, known)
        start, end = i - names.backward(i, i + p), i + p + names.forward(i, i + p)
        good = np.flatnonzero(end - start >= np.maximum(2 * p, least))
        good = good[np.lexsort((p[good], end[good], start[good]))]  # the smallest period of a stretch first
        start, end, p = start[good], end[good], p[good]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, p = start[new], end[new], p[new]
        starts.append(start), ends.append(end), periods.append(p)
        for s, e, q in zip(start.tolist(), end.tolist(), p.tolist(), strict=True):
            period_of[s:e], end_of[s:e] = q, e
        waiting.clear()

    for p in range(1, int(descending[0]) // 2 + 1 if len(descending) else 0):
        shortest = max(2 * p, least)
        many = int(np.searchsorted(-descending, -shortest, "right"))
        if not many:
            break
        stop = int(ahead[many - 1] + descending[many - 1])
        step = shortest - p
        at_i, at_j = level[0 : stop - p : step], level[p:stop:step]
        i = np.flatnonzero((at_i == at_j) & (at_i > 0)) * step
        if len(i):
            waiting.append((i, np.full(len(i), p)))
            size += len(i)
        if size >= TOGETHER:
            extend()
            size = 0
    if waiting:
        extend()
    start, end, period = (np.concatenate(x) for x in (starts, ends, periods))
    # a stretch found with several periods has the smallest of them
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    length = end - start
    start = at[start] if len(start) else start
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def planted(ids: list[int | None], sizes: np.ndarray) -> np.ndarray:
    """The place that each word is read from: a tenth of the documents end in a period chosen by their id."""
    begin = np.cumsum(sizes) - sizes
    source = np.arange(int(sizes.sum()))
    for i, b, n in zip(ids, begin.tolist(), sizes.tolist(), strict=True):
        if i is None or not n:
            continue
        h = crc32(str(i).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[b + a : b + n] = b + a + np.arange(n - a) % p
    return source


_RUNS = "doc_id long, n_words long, n_runs long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"
_DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _documents(batch: pa.RecordBatch, plant: bool) -> Iterator[tuple[bt.Chunk, bt.Words, np.ndarray, list[int], tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of each chunk its words, where each is read from, and its runs (starts within the chunk)."""
    for chunk in bt.chunks(batch.column("text")):
        found = bt.words(chunk, bt.NON_SPACE)
        sizes = found.per_row
        ids = batch.column("doc_id").slice(chunk.first, chunk.rows).to_pylist()
        source = planted(ids, sizes) if plant else np.arange(len(found.start))
        size = found.end - found.start
        ends = np.cumsum(size)
        flat = chunk.data[np.repeat(found.start - (ends - size), size) + np.arange(int(size.sum()))]
        # the words themselves are numbered, not hashes of them
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(flat)])
        number = np.asarray(spelled.dictionary_encode().indices).astype(np.int64) if len(size) else np.zeros(0, np.int64)
        yield chunk, found, source, ids, find(number[source], sizes)


def _dropped(words: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """True for each word that a run holds after its first period."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _each(batch: pa.RecordBatch, plant: bool) -> Iterator[tuple[int | None, list[int], list[int], list[int], int, bytes]]:
    """doc_id, the runs' starts, lengths and periods, number of words, and the words left."""
    for chunk, found, source, ids, (start, length, period) in _documents(batch, plant):
        gone = _dropped(len(source), start, length, period)
        data, first, last = chunk.data.tobytes(), found.start.tolist(), found.end.tolist()
        bounds = found.row.tolist()
        cut = np.searchsorted(start, found.row)
        for r, doc in enumerate(ids):
            b, e = bounds[r], bounds[r + 1]
            own = slice(cut[r], cut[r + 1])
            left = source[b:e][~gone[b:e]].tolist()
            yield doc, (start[own] - b).tolist(), length[own].tolist(), period[own].tolist(), e - b, b" ".join([data[first[k] : last[k]] for k in left])
    bt.release()


def _runs(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_each(batch, plant))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            doc, start, length, period, words = (pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True))[:5] or [[]] * 5, kinds, strict=True))
            text = pa.array([r[5] for r in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([doc, words, pc.list_value_length(start).cast(pa.int64()), start, length, period, text], names=["doc_id", "n_words", "n_runs", "starts", "lengths", "periods", "collapsed"])

    return run


def _digests(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for doc, start, length, period, _, left in _each(batch, plant):
                best = min(zip((-n for n in length), start, period, strict=True), default=None)
                longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start, length, period, strict=True))
                for column, value in zip(columns, (doc, len(start), *longest, sha256(lines.encode()).hexdigest(), sha256(left).hexdigest()), strict=True):
                    column.append(value)
            names = [f.split()[0] for f in _DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.string()) for k, c in enumerate(columns)], names=names)

    return run


def _texts(spark: SparkSession, documents: DataFrame) -> DataFrame:
    small_batches(spark)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_runs, starts, lengths, periods (of every run), collapsed.

    `collapsed` are the words left, joined by one blank, when every run keeps its first
    period only.  Words are runs of bytes without white space, unchanged.  Null and empty
    texts have no words and no runs.  Every row is judged by its own text, whatever its
    doc_id, null and repeated ones too.  A text of any length is taken whole, in memory in
    proportion to its words times the logarithm of its longest repetition.  Runs are listed
    by start, then period.  Other columns are ignored; an empty table gives no rows.
    """
    return _texts(spark, documents).mapInArrow(_runs(False), _RUNS)


def audit(spark: SparkSession, documents: DataFrame, plant: bool = True) -> DataFrame:
    """Per document: doc_id, n_runs, its longest run, digests of all runs and of the words left.

    Of runs of one length the one of smallest start, then period, is the longest; without a
    run start, length, period and exponent_milli are null.  With `plant` a tenth of the
    documents, chosen by a checksum of their id, are given a periodic end before they are
    searched; a document without an id is taken as it is.  All else as in `periodic_runs`.
    """
    return _texts(spark, documents).mapInArrow(_digests(plant), _DIGESTS)
