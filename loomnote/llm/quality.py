"""Document quality without hand labels: heuristic labellers, their accuracies, a linear scorer.

Eight heuristics vote good, bad or nothing on every text.  All documents' votes are
counted by pattern, a few thousand at most, and expectation-maximisation estimates from
the counts how often each heuristic is right and how likely each pattern is good.  Those
posteriors are the labels of a logistic scorer over hashed words and word shapes, which
then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import bytetext as bt
from loomnote.llm.shared import Tables

LABELLERS = ["repetition", "marks", "capitals", "bars", "variety", "function_words", "sentences", "word_length"]
#: The scorer is fitted on at most so many documents of at most so many characters, those of
#: lowest hash; all are scored, whole.
SAMPLE = 8000
SAMPLE_CHARS = 20_000
#: Variety is the share of distinct words in stretches of so many, so it does not follow a text's length.
STRETCH = 500
BITS = 16
NONE, BAD, GOOD = 0, 1, 2

_LETTER = bt.byte_class([(0, 64), (91, 96), (123, 127)])
_CAPITAL = ~bt.byte_class([(65, 90)])
_MARK = bt.byte_class([(0, 0x20), (0x2C, 0x2C), (0x2E, 0x2E), (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF), (0x27, 0x27), (0x2D, 0x2D)])
_KIND = np.zeros(256, np.uint8)
for _table, _code in ((_LETTER, 1), (_CAPITAL, 2), (_MARK, 3)):
    _KIND[_table] = _code
_KIND[0x30:0x3A] = 4
_STOP = ~bt.byte_class([(0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3A), (0x3F, 0x3F)])


def _vote(bad: np.ndarray, good: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(~known, NONE, np.where(bad, BAD, np.where(good, GOOD, NONE))).astype(np.int8)


class Chunk:
    """Votes and hashed features of a chunk's documents."""

    def __init__(self, chunk: bt.Chunk):
        self.rows, data = chunk.rows, chunk.data
        low = bt.LOWER[data]
        self.words = bt.words(chunk, bt.NON_SPACE)
        self.hash = bt.span_hash(low, self.words.start, self.words.end)
        self.owner = self.words.owner()
        self.count = self.words.per_row
        self.data, self.starts = data, chunk.starts

    def _share(self, table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[self.data])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def votes(self) -> np.ndarray:
        n, owner, hashes = self.count, self.owner, self.hash
        least = np.maximum(n, 1)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        repeated = np.bincount(owner[again], minlength=self.rows) / least
        letters, capitals, marks = (np.maximum(self._share(t), 0) for t in (_LETTER, _CAPITAL, _MARK))
        size = np.maximum(np.diff(self.starts), 1)
        length = self.words.end - self.words.start
        bar = np.zeros(len(hashes), bool)
        single = length == 1
        bar[single] = self.data[self.words.start[single]] == 0x7C
        bars = np.bincount(owner[bar], minlength=self.rows) / least
        part = (np.arange(len(owner)) - self.words.row[owner]) // STRETCH
        order = np.lexsort((hashes, part, owner))
        new = np.ones(len(order), bool)
        for values in (hashes, part, owner):
            new[1:] &= values[order][1:] == values[order][:-1]
        new[1:] = ~new[1:]
        distinct = np.bincount(owner[order][new], minlength=self.rows) / least
        short = np.bincount(owner[length <= 3], minlength=self.rows) / least
        mean = np.bincount(owner, weights=length, minlength=self.rows) / least
        ends = np.zeros(len(hashes), bool)
        if len(hashes):
            ends = _STOP[self.data[self.words.end - 1]]
        sentence = np.bincount(owner[ends], minlength=self.rows) / least
        some, many = n >= 5, n >= 20
        return np.stack(
            [
                _vote(repeated > 0.2, repeated < 0.05, some),
                _vote(marks / size > 0.08, marks / size < 0.03, some),
                _vote(capitals / np.maximum(letters, 1) > 0.5, capitals / np.maximum(letters, 1) < 0.2, letters >= 20),
                _vote(bars > 0.1, bars < 0.02, some),
                _vote(distinct < 0.15, distinct > 0.3, many),
                _vote(short < 0.08, (short > 0.15) & (short < 0.7), many),
                _vote(sentence < 0.01, (sentence > 0.03) & (sentence < 0.4), many),
                _vote((mean < 2.5) | (mean > 11), (mean > 3) & (mean < 9), some),
            ],
            axis=1,
        )

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, feature number and weight: hashed words, word shapes and doubled words."""
        kind = _KIND[self.data]
        start, end = self.words.start, self.words.end
        change = np.ones(len(kind), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[start] = True
        kept = np.flatnonzero(change)
        shape = bt.span_hash(kind[kept], np.searchsorted(kept, start), np.searchsorted(kept, end), seed=5)
        again = np.zeros(len(self.hash), np.uint64)
        again[1:] = ((self.hash[1:] == self.hash[:-1]) & (self.owner[1:] == self.owner[:-1])).astype(np.uint64)
        number = np.concatenate([self.hash, shape ^ np.uint64(0xABCDEF), bt.mix(again + np.uint64(99))]) >> np.uint64(64 - BITS)
        row = np.tile(self.owner, 3)
        code, times = np.unique(row.astype(np.int64) << BITS | number.astype(np.int64), return_counts=True)
        row, number = code >> BITS, code & (1 << BITS) - 1
        weight = np.log1p(times)
        norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=self.rows))
        return row, number, weight / np.maximum(norm[row], 1e-9)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of `good` for each vote pattern, and each labeller's accuracy on good and bad.

    A labeller's votes are taken as independent given the truth; abstaining tells nothing.
    """
    good, bad = patterns == GOOD, patterns == BAD
    votes = good.sum(axis=1) + bad.sum(axis=1)
    # texts fail in different ways, so one complaint is worth more at first than others' content
    belief = np.where(bad.any(axis=1), 0.05, np.where(votes > 0, 0.95, 0.5))
    accuracy = np.full((2, patterns.shape[1]), 0.7)
    for _ in range(rounds):
        for truth, weight in ((1, belief * counts), (0, (1 - belief) * counts)):
            agree = (good if truth else bad).T @ weight
            against = (bad if truth else good).T @ weight
            accuracy[truth] = np.clip((agree + 1) / (agree + against + 2), 0.02, 0.9995)
        prior = np.clip((belief @ counts) / max(counts.sum(), 1), 0.01, 0.99)
        up = np.log(prior) + good @ np.log(accuracy[1]) + bad @ np.log(1 - accuracy[1])
        down = np.log(1 - prior) + bad @ np.log(accuracy[0]) + good @ np.log(1 - accuracy[0])
        belief = 1 / (1 + np.exp(np.clip(down - up, -30, 30)))
    return belief, accuracy


def _code(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ 3 ** np.arange(votes.shape[1])


def _decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in bt.chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, chunk.rows), pa.array(_code(Chunk(chunk).votes()))], names=["doc_id", "pattern"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in bt.chunks(batch.column("text")):
            own = Chunk(chunk)
            row, number, weight = own.features()
            offsets = pa.array(np.searchsorted(row, np.arange(chunk.rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(_code(own.votes())), pa.ListArray.from_arrays(offsets, pa.array(number, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(weight, pa.float32()))],
                names=["pattern", "numbers", "weights"],
            )


def fit(rows: pa.Table, belief: dict[int, float], rounds: int = 60) -> np.ndarray:
    """Logistic weights (one a feature and a bias) for posteriors as soft labels, by gradient steps."""
    target = np.array([belief.get(p, 0.5) for p in rows.column("pattern").to_pylist()])
    numbers, weights = rows.column("numbers").combine_chunks(), rows.column("weights").combine_chunks()
    if isinstance(numbers, pa.ChunkedArray):
        numbers, weights = (pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type) for x in (numbers, weights))
    size = np.asarray(numbers.value_lengths()) if len(numbers) else np.zeros(0, np.int64)
    column, value = np.asarray(numbers.flatten()), np.asarray(weights.flatten(), dtype=np.float64)
    row = np.repeat(np.arange(len(size)), size)
    w, bias = np.zeros(1 << BITS), 0.0
    seen = np.zeros(1 << BITS)
    total = max(len(size), 1)
    good = max(target.sum(), 1e-9)
    balance = np.where(target >= 0.5, 0.5 * total / good, 0.5 * total / max(total - good, 1e-9))
    balance = np.clip(balance, 0.2, 5)
    for _ in range(rounds):  # AdaGrad over the whole sample
        margin = np.bincount(row, weights=w[column] * value, minlength=len(size)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) * balance
        slope = np.bincount(column, weights=error[row] * value, minlength=1 << BITS) / total + 1e-5 * w
        seen += slope**2
        w -= 0.5 * slope / np.sqrt(seen + 1e-12) * (slope != 0)
        bias -= 0.5 * error.sum() / total
    return np.append(w, bias)


def assess(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_votes, posterior, score (0 to 1, higher: better), keep.

    Texts without words, null ones among them, have posterior and score 0 and are not kept.
    Rows that share a doc_id, or have none, are judged one by one, so repeated rows score
    alike; other columns are ignored; an empty table gives no rows.
    """
    tables = Tables(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    voted = texts.select("doc_id", "text").mapInArrow(_votes, "doc_id long, pattern long")
    voted = tables.write(voted, "votes")
    found = voted.groupBy("pattern").count().collect()  # at most 3 ** 8 patterns
    codes = np.array([r["pattern"] for r in found], np.int64)
    belief, _ = estimate(_decode(codes), np.array([r["count"] for r in found], np.float64)) if len(codes) else (np.zeros(0), None)
    known = dict(zip(codes.tolist(), belief.tolist(), strict=True))
    # one text an id: repeated ids cannot make the sample larger
    short = texts.where((F.length("text") <= SAMPLE_CHARS) & F.col("doc_id").isNotNull())
    picked = short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(_features, "pattern long, numbers array<int>, weights array<float>").toArrow()
    held = spark.sparkContext.broadcast((fit(rows, known), known))
    tables.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = held.value
        for batch in batches:
            for chunk in bt.chunks(batch.column("text")):
                own = Chunk(chunk)
                votes = own.votes()
                row, number, value = own.features()
                margin = np.bincount(row, weights=weights[number] * value, minlength=own.rows) + weights[-1]
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                told = np.array([posterior.get(c, 0.5) for c in _code(votes).tolist()], np.float64)
                told[own.count == 0] = score[own.count == 0] = 0.0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, chunk.rows), pa.array((votes > 0).sum(axis=1).astype(np.int64)), pa.array(told), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "n_votes", "posterior", "score", "keep"])

    return texts.mapInArrow(run, "doc_id long, n_votes long, posterior double, score double, keep boolean")
