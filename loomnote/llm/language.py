"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays.

A text's tokens are its words and one end.  Grams of the highest order are counted; a
shorter gram's count is the number of different words that stand before it.  Each order
has three discounts, from the numbers of grams that were counted once to four times.

Counting.  A task counts the grams of a few million tokens, and hands them on in packed
pieces, one for each shard of the hash space; a piece is two byte strings, not a row a
gram.  A shard adds up its pieces as they come, writes a file (sorted hashes, then
columns of counts) to the folder that all executors share, and emits the packed counts of
the next shorter grams and of the contexts.  So a frequent gram is one entry a task,
however often it stands, and nothing is gathered by word or context.

Scoring.  Documents are packed into blocks.  A block asks each shard once for each of its
different grams, in hash order; the shard's file is memory-mapped and searched; the
answers, in the order of the questions, go back to the block, which finds its own order
again and needs no hashes with them.  No task reads more than the shards it serves, so
the model may be larger than any machine's memory.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import bytetext as bt
from loomnote.llm.shared import Tables

#: Longer grams cost disk in proportion: trigrams need some 2.3 times the space of bigrams.
ORDER = 2
#: Tokens that a task counts before it hands on, entries of a shard, bytes of a block's texts.
COUNT_TOKENS, SHARD_ENTRIES, BLOCK_BYTES = 1_500_000, 1_000_000, 8 << 20
#: The grams of the highest order are counted in so many passes over the texts, each for a
#: part of the hash space: the pieces under way take disk, the passes little time.
PASSES = 2
#: So many parts of the documents are scored one after the other, for the same reason.
PARTS = 2
_BEGIN, _END = np.uint64(bt.mix_int(0xBE61)), np.uint64(bt.mix_int(0xE4D))
_STEP = np.uint64(0x9FB21C651E98DF25)
#: The columns of counts: as a gram; as a context, its followers' sum, and how many followed
#: once, twice and more often; as a plain token.  Grams of the highest order have the first only.
COLUMNS = 6
_GRAM, _TOTAL, _ONCE, _TWICE, _MORE, _TOKEN = range(COLUMNS)
_PIECES = "level int, shard long, grams binary, counts binary, tally array<long>"
_PIECE_NAMES = ["level", "shard", "grams", "counts", "tally"]


def tokens(chunk: bt.Chunk, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with begin marks between documents, the tokens' places, and each document's number of them."""
    data = bt.LOWER[chunk.data]
    found = bt.words(chunk, bt.NON_SPACE, data)
    count = found.per_row + 1
    row = np.repeat(np.arange(chunk.rows), count)
    at = np.arange(len(row)) + (row + 1) * (order - 1)
    out = np.full(len(row) + chunk.rows * (order - 1), _BEGIN)
    out[at] = _END
    word = np.arange(len(found.start)) + found.owner()  # one end stands after each document before it
    out[at[word]] = bt.span_hash(data, found.start, found.end)
    return out, at, count


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    key = np.full(len(columns[0]), np.uint64(len(columns)))
    for column in columns:
        key = bt.mix(key * _STEP + column)
    return key


def _summed(grams: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different grams in the order of their keys, their counts added up; without counts each counts once."""
    key = keys_of(list(grams))
    order = np.argsort(key)
    key = key[order]
    first = _firsts(key)
    if counts is None:
        total = np.diff(np.append(first, len(key)))[None, :]
    else:
        total = np.add.reduceat(counts[:, order], first, axis=1) if len(first) else counts
    return key[first], grams[:, order[first]], total


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """The places of sorted values where another one begins."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _shards(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys the shards they are in, and where each shard's begin and end."""
    shard = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    start = _firsts(shard)
    return shard[start], np.append(start, len(key))


def _pieces(level: int, grams: np.ndarray, counts: np.ndarray | None, bits: int, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    key, grams, counts = _summed(grams, counts)
    yield from _packed(level, key, grams, counts, bits, part, parts)


def _packed(level: int, key: np.ndarray, grams: np.ndarray, counts: np.ndarray, bits: int, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """Different grams in the order of their keys, cut by shard; of several parts the shards of one."""
    shards, cut = _shards(key, bits)
    rows: list[tuple[int, bytes, bytes]] = []
    size = 0
    for shard, s, e in zip(shards.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if shard % parts != part:
            continue
        rows.append((shard, grams[:, s:e].tobytes(), counts[:, s:e].tobytes()))
        size += len(rows[-1][1]) + len(rows[-1][2])
        if size > 2 << 20:
            yield _piece_batch(level, rows)
            rows, size = [], 0
    if rows:
        yield _piece_batch(level, rows)


def _piece_batch(level: int, rows: list[tuple[int, bytes, bytes]], tally: list[int] | None = None) -> pa.RecordBatch:
    shard, grams, counts = zip(*rows, strict=True)
    columns = [pa.array([level] * len(rows), pa.int32()), pa.array(shard, pa.int64()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary()), pa.array([tally] * len(rows), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=_PIECE_NAMES)


def _count(order: int, bits: int, part: int, parts: int):
    """Packed counts of the highest order's grams of one part of the hash space, and in the first pass of plain tokens."""

    def out(sequences: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        grams = np.concatenate([np.stack([seq[at - order + 1 + j] for j in range(order)]) for seq, at in sequences], axis=1)
        yield from _pieces(order, grams, None, bits, part, parts)
        if part == 0:
            key, words, count = _summed(grams[-1:], None)
            counts = np.zeros((COLUMNS, len(key)), np.int64)
            counts[_TOKEN] = count
            yield from _packed(1, key, words, counts, bits)
        bt.release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for chunk in bt.chunks(batch.column("text")):
                seq, at, _ = tokens(chunk, order)
                held.append((seq, at))
                size += len(at)
                if size >= COUNT_TOKENS:
                    yield from out(held)
                    held, size = [], 0
        if size:
            yield from out(held)

    return run


def _merge(level: int, order: int, bits: int, root: str):
    """Adds up each shard's pieces; those of `level` become a file, and pieces of the next shorter grams.

    Pieces come sorted by level and shard.  Those of other levels are added up and handed on.
    """

    def close(own: int, shard: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        grams, counts = (np.concatenate(x, axis=1) for x in zip(*held, strict=True))
        if own != level:
            yield from _pieces(own, grams, counts, bits)
            return
        key, grams, counts = _summed(grams, counts)
        Shard.write(f"{root}/{level}-{shard}", key, counts)
        gram = counts[_GRAM]
        tally = [np.count_nonzero(gram), *(np.count_nonzero(gram == n) for n in (1, 2, 3, 4)), int(gram.sum())]
        tally += [int(counts[_TOKEN].sum()), np.count_nonzero(counts[_TOKEN])] if level == 1 else [0, 0]
        yield _piece_batch(level, [(shard, None, None)], [int(t) for t in tally])
        if level > 1:
            known = gram > 0
            grams, gram = grams[:, known], gram[known]
            lower, context = np.zeros((2, COLUMNS, len(gram)), np.int64)
            lower[_GRAM] = 1
            context[_TOTAL], context[_ONCE], context[_TWICE], context[_MORE] = gram, gram == 1, gram == 2, gram > 2
            yield from _pieces(level - 1, np.concatenate([grams[1:], grams[:-1]], axis=1), np.concatenate([lower, context], axis=1), bits)
        bt.release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for k in range(len(batch)):
                own, shard = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if now != (own, shard):
                    if now:
                        yield from close(*now, held)
                    now, held, size = (own, shard), [], 0
                grams = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64).reshape(own, -1)
                counts = np.frombuffer(batch.column(3)[k].as_buffer(), np.int64).reshape(1 if own == order else COLUMNS, -1)
                held.append((grams, counts))
                size += grams.shape[1]
                if size > 2 * SHARD_ENTRIES:  # many tasks have the same grams
                    _, *both = _summed(*(np.concatenate(x, axis=1) for x in zip(*held, strict=True)))
                    held, size = [tuple(both)], both[0].shape[1] // 2
        if now:
            yield from close(*now, held)

    return run


class Shard:
    """A file of sorted keys and their counts, memory-mapped.

    A count below 255 is one byte; of the others places and values follow the keys.
    """

    @staticmethod
    def write(uri: str, key: np.ndarray, counts: np.ndarray) -> None:
        store, path = _store(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        large = [np.flatnonzero(c >= 255) for c in counts]
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(np.array([len(key), len(counts), *map(len, large)], np.int64).tobytes())
            out.write(key.tobytes())
            for places, column in zip(large, counts, strict=True):
                out.write(places.tobytes())
                out.write(column[places].tobytes())
            for column in counts:
                out.write(np.minimum(column, 255).astype(np.uint8).tobytes())
        store.move(part, path)  # a task that runs twice writes the same file

    def __init__(self, uri: str):
        store, path = _store(uri)
        if isinstance(store, stores.LocalFileSystem):
            data = np.memmap(path, np.uint8, "r")
        else:  # a store that cannot be mapped: a copy that goes with this object
            with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as source:
                while block := source.read(1 << 20):
                    copy.write(block)
                copy.flush()
                data = np.memmap(copy, np.uint8, "r")
        n, columns = data[:16].view(np.int64).tolist()
        at = 16 + 8 * columns
        sizes = data[16:at].view(np.int64).tolist()
        self.key = data[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.large = []
        for size in sizes:
            both = data[at : at + 16 * size].view(np.int64)
            self.large.append((both[:size], both[size:]))
            at += 16 * size
        self.small = [data[at + i * n : at + (i + 1) * n] for i in range(columns)]

    def counts(self, key: np.ndarray) -> np.ndarray:
        """A column for each key, all 0 for one that is not here."""
        out = np.zeros((len(self.small), len(key)), np.int64)
        if not len(self.key):
            return out
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = np.flatnonzero(self.key[place] == key)
        place = place[hit]
        for row, small, (places, values) in zip(out, self.small, self.large, strict=True):
            row[hit] = small[place]
            if len(places):
                at = np.minimum(np.searchsorted(places, place), len(places) - 1)
                much = places[at] == place
                row[hit[much]] = values[at[much]]
        return out


def _store(uri: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(uri)


@dataclass
class Model:
    """Where the shards are, and what holds for whole orders."""

    root: str
    order: int
    bits: int
    tokens: int
    vocabulary: int
    #: Of each order, from 1: the discounts of counts 1, 2 and more.
    discounts: list[tuple[float, float, float]]
    #: Of single tokens: the sum of their counts as grams, and how many have counts 1, 2, more.
    unigrams: tuple[int, int, int, int]


def discounts(once: int, twice: int, thrice: int, four: int) -> tuple[float, float, float]:
    """Chen and Goodman's; where a number they divide by is 0, or off the range, the nearest that leaves some mass."""
    y = once / (once + 2 * twice) if once + twice else 0.5
    made = [1 - 2 * y * twice / once if once else y, 2 - 3 * y * thrice / twice if twice else 2 * y, 3 - 4 * y * four / thrice if thrice else 3 * y]
    return tuple(min(max(d, 0.1), n - 0.1) for n, d in enumerate(made, 1))


def train(spark: SparkSession, documents: DataFrame, tables: Tables, order: int = ORDER, passes: int = PASSES) -> Model:
    """Count the texts of `documents`; the shards are written below the tables' folder and go with it.

    Null texts are read as empty: one end.  Rows are counted one by one, repeated ones too.
    An empty table gives a model of one unknown token.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    texts = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6 / SHARD_ENTRIES)))))
    parts = max(1, min(passes, 1 << bits))
    root = f"{tables.root}/shards"
    tallies = {}
    pieces: list[DataFrame] = [texts.mapInArrow(_count(order, bits, part, parts), _PIECES) for part in range(parts)]
    for level in range(order, 0, -1):
        merged = []
        for number, piece in enumerate(pieces):
            dealt = piece.select("level", "shard", "grams", "counts", "tally").repartition(max(1 << bits, spark.sparkContext.defaultParallelism), "level", "shard")
            merge = dealt.sortWithinPartitions("level", "shard").mapInArrow(_merge(level, order, bits, root), _PIECES)
            merged.append(tables.write(merge, f"level-{level}-{number}"))
        whole = merged[0]
        for other in merged[1:]:
            whole = whole.unionAll(other)
        sums = whole.where("tally is not null").agg(*(F.sum(F.get("tally", F.lit(i))).alias(f"t{i}") for i in range(8))).first()
        tallies[level] = [int(x or 0) for x in sums]
        pieces = [whole.where("tally is null")]
        for number in range(parts if level == order - 1 else 1):
            if level < order:
                tables.drop(f"level-{level + 1}-{number}")
    types, once, twice, _, _, total, count, vocabulary = tallies[1]
    return Model(root, order, bits, count, vocabulary, [discounts(*tallies[k][1:5]) for k in range(1, order + 1)], (total, once, twice, types - once - twice))


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents packed into rows of some size: their ids and texts."""
    ids, texts, size = [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], names=["ids", "texts"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc), texts.append(text)
            size += len(text.encode()) + 16
            if size >= BLOCK_BYTES:
                yield out()
                ids, texts, size = [], [], 0
    if ids:
        yield out()


class Asked:
    """The different grams that a block's tokens need counts of, by order and hash.

    Of the highest order those that end in a token; of the others all, since each is the
    context of the token after it or ends in a token.
    """

    def __init__(self, texts: pa.Array, order: int):
        self.order = order
        sequences, places, counts, size = [], [], [], 0
        for chunk in bt.chunks(texts):
            seq, at, count = tokens(chunk, order)
            sequences.append(seq), places.append(at + size), counts.append(count)
            size += len(seq)
        seq, self.at, self.count = (np.concatenate(x) for x in (sequences, places, counts))
        last = len(seq)
        #: Keys of all grams of an order, by the place where they end, from order - 1 on.
        self.all = [keys_of([seq[j : last - k + 1 + j] for j in range(k)]) for k in range(1, order)]
        self.all.append(keys_of([seq[self.at - order + 1 + j] for j in range(order)]))

    def keys(self) -> Iterator[np.ndarray]:
        """Of each order the different keys, sorted."""
        for key in self.all:
            ordered = np.sort(key)
            yield ordered[_firsts(ordered)]

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each order the different keys, and of each token the place among them of the gram that ends in it and of the words before it."""
        for k, key in enumerate(self.all, 1):
            order = np.argsort(key)
            first = _firsts(key[order])
            place = np.zeros(len(key), np.int64)
            place[first[1:]] = 1
            which = np.empty(len(key), np.int64)
            which[order] = np.cumsum(place)
            top = k == self.order
            yield key[order[first]], which if top else which[self.at - k + 1], which[:0] if top else which[self.at - k]


def _ask(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block = batch.column("block")[k].as_py()
                asked = Asked(batch.column("texts")[k].values, order)
                for level, key in enumerate(asked.keys(), 1):
                    shards, cut = _shards(key, bits)
                    for i in range(0, len(shards), 64):
                        rows = [(s, key[cut[j] : cut[j + 1]].tobytes()) for j, s in enumerate(shards[i : i + 64].tolist(), i)]
                        yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([level] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "level", "shard", "data"])
                del asked
                bt.release()

    return run


def _answer(root: str):
    """Counts in place of keys; the rows come by shard, so that each file is opened once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            levels, shards = batch.column("level").to_pylist(), batch.column("shard").to_pylist()
            out = []
            for k, own in enumerate(zip(levels, shards, strict=True)):
                if own != now:
                    now, shard = own, Shard(f"{root}/{own[0]}-{own[1]}") if _exists(f"{root}/{own[0]}-{own[1]}") else None
                key = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint64)
                out.append(shard.counts(key).tobytes() if shard else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=batch.schema.names)

    return run


def _exists(uri: str) -> bool:
    store, path = _store(uri)
    return store.get_file_info(path).type == stores.FileType.File


def _probabilities(counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of each token its probability after the words before it, and its plain count.

    counts: of each order the counts of the different grams, and `Asked.places`.
    """
    total, *kinds = model.unigrams
    plain = counts[0][0][_TOKEN][counts[0][1]]
    p = np.full(len(plain), 1 / (model.vocabulary + 1))
    for k, (table, which, _) in enumerate(counts, 1):
        d = np.array([0, *model.discounts[k - 1]])
        gram = table[_GRAM][which]
        if k == 1:
            follow, one, two, more = (np.full(len(gram), x) for x in (total, *kinds))
        else:
            table, _, before = counts[k - 2]
            follow, one, two, more = (table[c][before] for c in (_TOTAL, _ONCE, _TWICE, _MORE))
        better = (gram - d[np.minimum(gram, 3)] + (d[1] * one + d[2] * two + d[3] * more) * p) / np.maximum(follow, 1)
        p = np.where(follow > 0, better, p)
    return p, plain


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(model: Model):
    """Rows of a block: its texts, then the answers by order and shard."""

    def close(ids: pa.Array, texts: pa.Array, answers: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        asked = Asked(texts, model.order)
        counts = []
        for level, (key, which, before) in enumerate(asked.places(), 1):
            table = np.zeros((COLUMNS if level < model.order else 1, len(key)), np.int64)
            shards, cut = _shards(key, model.bits)
            for own, shard, data in answers:
                if own == level and data:
                    at = int(np.searchsorted(shards, shard))
                    table[:, cut[at] : cut[at + 1]] = np.frombuffer(data, np.int64).reshape(len(table), -1)
            counts.append((table, which, before))
        p, plain = _probabilities(counts, model)
        first = np.cumsum(asked.count) - asked.count
        base = np.log10((plain + 1) / (model.tokens + model.vocabulary + 1))
        sums = [np.add.reduceat(x, first) for x in ((plain > 0).astype(np.int64), base, np.log10(p))]
        bt.release()
        return pa.RecordBatch.from_arrays([ids, pa.array(asked.count), *map(pa.array, sums)], names=[f.split()[0] for f in _SCORES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, answers = None, None, []
        for batch in batches:
            for k in range(len(batch)):
                block, level = batch.column("block")[k].as_py(), batch.column("level")[k].as_py()
                if block != now:
                    if now is not None:
                        yield close(*texts, answers)
                    now, texts, answers = block, None, []
                if level == 0:
                    texts = batch.column("ids")[k].values, batch.column("texts")[k].values
                else:
                    answers.append((level, batch.column("shard")[k].as_py(), batch.column("data")[k].as_py()))
        if now is not None:
            yield close(*texts, answers)

    return run


def score(spark: SparkSession, documents: DataFrame, model: Model, tables: Tables, parts: int = PARTS) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score, score.

    Scores are sums of log10 over the tokens: of (count + 1) / (all + types + 1), and of the
    model's probabilities, where a token that it never met has the part of an unknown one.
    A null or empty text has one token, its end.  Rows are scored one by one, whatever their
    doc_id, null and repeated ones too; an empty table gives no rows.  Long texts are scored
    whole, in a block of their own.  Other columns are ignored.  The documents are dealt into
    `parts`, scored in turn, each written with the tables.
    """
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = None
    for part in range(max(1, parts)):
        own = plain.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, parts))) == part)
        rows = tables.write(_scored(spark, own, model, tables), f"scores-{part}")
        for name in ("blocks", "answers"):
            tables.drop(name)
        scored = rows if scored is None else scored.unionAll(rows)
    return scored


def _scored(spark: SparkSession, plain: DataFrame, model: Model, tables: Tables) -> DataFrame:
    blocks = plain.mapInArrow(_block, "ids array<long>, texts array<string>").withColumn("block", F.monotonically_increasing_id())
    blocks = tables.write(blocks, "blocks")
    shards = max(1 << model.bits, spark.sparkContext.defaultParallelism)
    questions = blocks.select("block", "texts").mapInArrow(_ask(model.order, model.bits), "block long, level int, shard long, data binary")
    questions = questions.repartition(shards, "level", "shard").sortWithinPartitions("level", "shard")
    answers = tables.write(questions.mapInArrow(_answer(model.root), "block long, level int, shard long, data binary"), "answers")
    texts = blocks.selectExpr("block", "0 as level", "0L as shard", "cast(null as binary) as data", "ids", "texts")
    answered = answers.selectExpr("*", "cast(null as array<long>) as ids", "cast(null as array<string>) as texts")
    dealt = texts.unionAll(answered).repartition(shards, "block").sortWithinPartitions("block", "level", "shard")
    return dealt.mapInArrow(_score(model), _SCORES)


def held_out(doc_id: str = "doc_id", of: int = 7, remainder: int = 2):
    """True for the part of the documents that the model does not learn from; also without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == remainder, F.lit(True))


def assess(spark: SparkSession, documents: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learned from the documents that are not held out; all are scored.  Nulls, repeated rows,
    long and empty texts, empty tables and other columns: as in `train` and `score`.
    """
    tables = Tables(spark)
    model = train(spark, documents.where(~held_out()), tables, order)
    scored = score(spark, documents, model, tables)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return tables.finish(scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity))
