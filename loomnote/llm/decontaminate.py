"""Benchmark decontamination with suffix arrays over the training text.

Every task reads its documents in shards of bounded size and builds a suffix array over
each shard's words, in the order of their first ten words; a match is extended word by
word, so deeper order is not needed.  The array is sparse: it holds the suffixes that
start with a pair of words which some benchmark item holds too (or with an item of one
word), since no other suffix can match.  Every benchmark suffix is found by two binary
searches; the range between them lists each place where its first ten words occur.  Of
those, the ones that do not continue a match to the left are extended to the longest
verbatim match, and the matches decide which words are hit and which documents go.

Nothing is shuffled.  The benchmark goes to the executors in blocks of at most
`block_words` words, one pass over the documents a block, each written before the next
begins, so what is broadcast and held stays bounded whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import bytetext as bt
from loomnote.llm.shared import Tables, fresh, small_batches

WINDOW = 10
BLOCK_WORDS = 500_000
#: Pairs of a place in a shard and one in the items that are looked at together.
PAIRS = 2_000_000
_ALL = np.uint32(0xFFFFFFFF)


class Index:
    """The suffixes of a block of items, by their first words, as keys that compare like word sequences."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        column = pa.array([text or "" for _, text in items], pa.string())
        hashes, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for chunk in bt.chunks(column):
            data = bt.LOWER[chunk.data]
            spans = bt.words(chunk, bt.ALNUM, data)
            hashes.append(bt.span_hash(data, spans.start, spans.end))
            lengths.append(spans.per_row)
        words, sizes = np.concatenate(hashes), np.concatenate(lengths)
        self.vocabulary = np.unique(words)
        #: Each word's number, its item and where that begins and ends.
        self.words = (np.searchsorted(self.vocabulary, words) + 1).astype(np.uint32)
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        self.begin = np.cumsum(sizes) - sizes
        self.end = np.cumsum(sizes)
        at = np.arange(len(words))
        left = self.end[self.item] - at
        starts = at[(left >= window) | (at == self.begin[self.item])]
        size = np.minimum(left[starts], window)
        own = np.arange(window) < size[:, None]
        rows = self.words[np.minimum(starts[:, None] + np.arange(window), max(len(words) - 1, 0))]
        keys, lead, which = np.unique(_packed(np.where(own, rows, _ALL), window), return_index=True, return_inverse=True)
        #: Distinct keys, least and greatest, their lengths, and the suffixes of each.
        self.high, self.low, self.size = keys, _packed(np.where(own, rows, 0)[lead], window), size[lead]
        self.starts = starts[np.argsort(which, kind="stable")]
        self.of = np.searchsorted(np.sort(which), np.arange(len(keys) + 1))
        several = size > 1
        self.pairs = np.unique(rows[several, 0].astype(np.uint64) << np.uint64(32) | rows[several, min(1, window - 1)])
        self.single = np.unique(rows[~several, 0])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Benchmark word numbers from 1; 0 for other words."""
        out = np.zeros(len(hashes), np.uint32)
        if not len(self.vocabulary):
            return out
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == hashes[maybe]
        out[maybe[same]] = place[same] + 1
        return out


def _packed(rows: np.ndarray, window: int) -> np.ndarray:
    """Rows of word numbers as byte strings that sort as the sequences do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * window}").ravel()


def _in_sorted(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


class Shard:
    """The words of some documents, with the suffix array over those that can match."""

    def __init__(self, chunk: bt.Chunk, index: Index):
        data = bt.LOWER[chunk.data]
        self.words = bt.words(chunk, bt.ALNUM, data)
        self.ids = index.ids(bt.span_hash(data, self.words.start, self.words.end))
        n, w = len(self.ids), index.window
        self.left, self.owner = self.words.left(), self.words.owner()
        left = self.left
        known = np.flatnonzero(self.ids)
        after = np.zeros(len(known), np.uint64)
        inner = left[known] > 1
        after[inner] = self.ids[known[inner] + 1]
        pair = self.ids[known].astype(np.uint64) << np.uint64(32) | after
        starts = known[_in_sorted(pair, index.pairs) | _in_sorted(self.ids[known], index.single)]
        ahead = starts[:, None] + np.arange(w)
        rows = self.ids[np.minimum(ahead, max(n - 1, 0))]
        rows[rows == 0] = len(index.vocabulary) + 1  # a word that no item has
        rows[np.arange(w) >= left[starts][:, None]] = 0  # the document's end sorts first
        keys = _packed(rows, w)
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = starts[order], keys[order]

    def search(self, index: Index) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct benchmark window the range of suffixes that start with it."""
        return np.searchsorted(self.keys, index.low, "left"), np.searchsorted(self.keys, index.high, "right")

    def matches(self, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest matches of `window` words or a whole shorter item: places here, in the items' words, and lengths."""
        first, last = self.search(index)
        count, each = np.maximum(last - first, 0), np.diff(index.of)
        found = np.flatnonzero(count)
        begins = [self._begins(index, first, count, part) for part in self._slices(found, count * each)]
        place, at, length = (np.concatenate(x) for x in zip(*begins, strict=True)) if begins else (np.zeros(0, np.int64),) * 3
        row = np.searchsorted(self.words.row, place, "right") - 1
        stop = np.minimum(self.words.row[row + 1] - place, index.end[index.item[at]] - at)
        going = np.flatnonzero(length < stop)
        while len(going):
            going = going[self.ids[place[going] + length[going]] == index.words[at[going] + length[going]]]
            length[going] += 1
            going = going[length[going] < stop[going]]
        return place, at, length


    @staticmethod
    def _slices(found: np.ndarray, cost: np.ndarray) -> Iterator[np.ndarray]:
        """Runs of `found` of at most PAIRS pairs together, or of one key."""
        total, i = np.cumsum(cost[found]), 0
        while i < len(found):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
            yield found[i:j]
            i = j

    def _begins(self, index: Index, first: np.ndarray, count: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some keys the pairs (place here, in the items' words) that continue no match to the left."""
        which = np.repeat(found, count[found])
        inner = np.arange(len(which)) - np.repeat(np.cumsum(count[found]) - count[found], count[found])
        place = self.suffixes[first[which] + inner]
        each = index.of[which + 1] - index.of[which]
        entry = np.repeat(index.of[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        place, length, at = np.repeat(place, each), np.repeat(index.size[which], each), index.starts[entry]
        inside = (self.left[place] < self.words.per_row[self.owner[place]]) & (at > index.begin[index.item[at]])
        new = ~inside | (self.ids[place - inside] != index.words[at - inside])
        return place[new], at[new], length[new]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in blocks of bounded size; an item never falls apart."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null")
    for name, text in rows.toLocalIterator():
        n = len(text or "") // 2 + 1  # no text has more words than this
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += n
    if block:
        yield block


STATE = "doc_id long, text string, n_words long, n_hit long, hits binary, items array<string>"
_STATE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))])
MATCH = "doc_id long, item_id string, doc_word long, item_word long, n_words long"
_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])


def _hits(shard: Shard, index: Index) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of the shard some match covers, and the items of each document."""
    place, at, length = shard.matches(index)
    cover = np.zeros(len(shard.ids) + 1, np.int32)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + length, -1)
    rows = np.searchsorted(shard.words.row, place, "right") - 1
    items: dict[int, set[str]] = {}
    for code in np.unique(rows * max(1, len(index.names)) + index.item[at]).tolist():
        row, item = divmod(code, len(index.names))
        items.setdefault(row, set()).add(index.names[item])
    return np.cumsum(cover[:-1]) > 0, items


def _pass(index, first: bool, last: bool):
    """One block's pass over the documents; hits (packed bits, one a word) and items add up."""

    def run(batches):
        own = index.value
        for batch in batches:
            before = None if first else (batch.column("hits").to_pylist(), batch.column("items").to_pylist())
            for chunk in bt.chunks(batch.column("text")):
                shard = Shard(chunk, own)
                hit, items = _hits(shard, own)
                bounds = shard.words.row
                counts, packed, names = np.zeros(chunk.rows, np.int64), [None] * chunk.rows, [[]] * chunk.rows
                touched = set(items) if first else range(chunk.rows)
                for r in touched:
                    bits, own_names = hit[bounds[r] : bounds[r + 1]], items.get(r, set())
                    if before:
                        k = chunk.first + r
                        if before[0][k]:
                            bits = bits | np.unpackbits(np.frombuffer(before[0][k], np.uint8), count=len(bits)).astype(bool)
                        own_names = own_names | set(before[1][k] or ())
                    counts[r] = np.count_nonzero(bits)
                    if counts[r]:
                        packed[r], names[r] = np.packbits(bits).tobytes(), sorted(own_names)
                texts = pa.nulls(chunk.rows, pa.string()) if last else batch.column("text").slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, chunk.rows), texts, pa.array(np.diff(bounds)), pa.array(counts), pa.array(packed, pa.binary()), pa.array(names, pa.list_(pa.string()))],
                    schema=_STATE,
                )

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, hits (packed bits, one a word; null: none), items.

    A word is hit if it lies in an occurrence of `window` consecutive words of an item
    (of the whole item, if that is shorter).  Null and empty texts have no words.  Items
    without words or with a null item_id occur nowhere.  Rows that share a doc_id are
    judged one by one.  Other columns of either table are ignored.
    """
    tables = Tables(spark)
    state, first, turn = _texts(documents), True, 0
    blocks = _blocks(benchmark, block_words)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        index = spark.sparkContext.broadcast(Index(block, window))
        state = state.mapInArrow(_pass(index, first, following is None), STATE)
        if following is None:
            return state.drop("text") if first else tables.finish(state.drop("text"))
        state = tables.write(state, f"pass-{turn}")  # ends the pass: one index at a time is held
        index.destroy()
        if turn:
            tables.drop(f"pass-{turn - 1}")
        block, first, turn = following, False, turn + 1


def matches(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every longest verbatim match of a document with an item: doc_id, item_id, doc_word, item_word, n_words.

    Words are counted from 0.  A match has `window` words at least, or is a whole shorter
    item, and cannot be made longer at either end.  Null and empty texts match nothing;
    repeated rows, and rows that share an id or have none, match one by one.  Empty tables
    give no rows.
    """

    def locate(index):
        def run(batches):
            own = index.value
            for batch in batches:
                ids = batch.column("doc_id")
                for chunk in bt.chunks(batch.column("text")):
                    shard = Shard(chunk, own)
                    place, at, length = shard.matches(own)
                    row, item = np.searchsorted(shard.words.row, place, "right") - 1, own.item[at]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(chunk.first + row)), pa.array([own.names[i] for i in item.tolist()], pa.string()), pa.array(place - shard.words.row[row]), pa.array(at - own.begin[item]), pa.array(length)],
                        schema=_MATCH,
                    )

        return run

    small_batches(spark)
    tables, paths = Tables(spark), []
    for turn, block in enumerate(_blocks(benchmark, block_words)):
        index = spark.sparkContext.broadcast(Index(block, window))
        paths.append(tables.write(_texts(documents).mapInArrow(locate(index), MATCH), f"matches-{turn}"))
        index.destroy()
    out = spark.createDataFrame([], MATCH)
    for part in paths:
        out = out.unionAll(part)
    return tables.finish(out)


def remove_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit word, with all their columns; rows with a null doc_id stay.

    Null and empty texts stay.  Rows that share a doc_id go together if any of them is hit;
    repeated rows stay or go alike.
    """
    name = fresh(documents.columns, "hit_doc")
    hit = scan(spark, documents, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct()
    return documents.join(hit, F.col("doc_id") == F.col(name), "left_anti")
