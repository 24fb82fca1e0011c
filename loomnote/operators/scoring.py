"""Scores of many queries against many rows as matrix products over Arrow batches.

A block of queries is sent to every task; each task scores its rows against it and hands
on no more than k rows a query for every so many it has scored.  Beyond `QUERY_BLOCK`
queries the rows are passed over once a block, so what is sent is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 512
SLICE = 1024
#: Scores that a task holds before it keeps the best k a query.
HELD = 100_000


def blocks_of(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries in tables of about QUERY_BLOCK rows, dealt by hash of their id."""
    total = queries.count()
    parts = max(1, -(-total // QUERY_BLOCK))
    for part in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most: what is made of one is held but a slice long."""
    for batch in batches:
        for i in range(0, len(batch), SLICE):
            yield batch.slice(i, SLICE)


class Best:
    """The k best (score, then smaller id) a query of what a task has scored; k None: all."""

    def __init__(self, k: int | None):
        self.k, self.size = k, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, name: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, name, score))
            self.size += len(query)
            if self.k is not None and self.size > HELD:
                self.parts = [self.kept()]
                self.size = len(self.parts[0][0])

    def add_dense(self, names: np.ndarray, score: np.ndarray, fits: np.ndarray) -> None:
        """A matrix (queries, rows) of scores; entries that do not fit are left out."""
        if self.k is not None and score.shape[1] > self.k:
            least = -np.partition(np.where(fits, -score, np.inf), self.k - 1, axis=1)[:, self.k - 1 : self.k]
            fits = fits & (score >= least)
        query, row = np.nonzero(fits)
        self.add(query, names[row], score[query, row])

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, name, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        if self.k is None:
            return query, name, score
        order = np.lexsort((name, -score, query))
        query, name, score = query[order], name[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return query[place < self.k], name[place < self.k], score[place < self.k]

    def told(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        query, name, score = self.kept()
        for i in range(0, len(query), 65_536):
            cut = slice(i, i + 65_536)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[cut])), pa.array(name[cut].tolist(), pa.string()), pa.array(score[cut])], names=["query_id", "chunk_id", "score"])


def over_blocks(queries: DataFrame, one: Callable[[pa.Table], DataFrame | None], empty: str) -> DataFrame:
    """The union of `one` over blocks of the queries; a table of schema `empty` if there are none."""
    out = None
    for block in blocks_of(queries):
        part = one(block) if len(block) else None
        out = part if out is None else out if part is None else out.unionAll(part)
    return queries.sparkSession.createDataFrame([], empty) if out is None else out


def _ids(block: pa.Table) -> pa.Array:
    column = block.column("query_id").combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def cosines(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score: (1 + cosine) / 2 to six places, the k best a task and query.

    Vectors of another length than the query's, or without length, have the cosine 0.
    """
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, score double"

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def by_size(lists: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(v) for v in lists])
        return {s: (np.flatnonzero(sizes == s), unit(np.array([lists[i] for i in np.flatnonzero(sizes == s)], np.float64).reshape(-1, s))) for s in set(sizes.tolist())}

    def one(block: pa.Table) -> DataFrame:
        held = queries.sparkSession.sparkContext.broadcast((_ids(block), by_size([v or [] for v in block.column("vec").to_pylist()])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = held.value
            best = Best(k)
            for batch in batches:
                for i in range(0, len(batch), SLICE):
                    part = batch.slice(i, SLICE)
                    names = np.array(part.column("chunk_id").to_pylist(), object).astype(str)
                    score = np.zeros((len(ids), len(part)))
                    for size, (rows, y) in by_size(part.column("vec").to_pylist()).items():
                        if size in asked:
                            score[np.ix_(asked[size][0], rows)] = asked[size][1] @ y.T
                    best.add_dense(names, np.round((1 + score) / 2, 6), np.ones(score.shape, bool))
            yield from best.told(ids)

        rows = vectors.where("vec is not null and chunk_id is not null and not exists(vec, x -> x is null)").select(F.col("chunk_id").cast("string").alias("chunk_id"), "vec")
        return rows.mapInArrow(run, schema)

    return over_blocks(queries.select("query_id", "vec"), one, schema)


def postings(chunks: DataFrame, fields: tuple[str, ...], words, terms: pa.Array) -> DataFrame:
    """Per chunk: chunk_id, and for each field its length (l0, ..) and the given terms in it (t0, ..) with their counts (c0, ..)."""
    held = chunks.sparkSession.sparkContext.broadcast(terms)
    names = [f"{a}{i}" for i in range(len(fields)) for a in "ltc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in slices(batches):
            out = [batch.column(0)]
            for column in batch.columns[1:]:
                size = np.asarray(column.value_lengths())
                term = np.asarray(pc.index_in(column.flatten(), held.value).fill_null(-1))
                row = np.repeat(np.arange(len(batch)), size)[term >= 0]
                code, count = np.unique(row.astype(np.int64) << 32 | term[term >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(code >> 32, np.arange(len(batch) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (code & (1 << 32) - 1, count)]
                out += [pa.array(size, pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays(out, names=["chunk_id", *names])

    rows = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("string").alias("chunk_id"), *(words(F.col(f)).alias(f"w{i}") for i, f in enumerate(fields)))
    kinds = {"l": "int", "t": "array<int>", "c": "array<int>"}
    return rows.mapInArrow(run, "chunk_id string, " + ", ".join(f"{n} {kinds[n[0]]}" for n in names))


def weighed(counted: DataFrame, block: pa.Table, terms: pa.Array, statistics: list[tuple[float, float, np.ndarray]], k1: float, b: float, k: int | None, schema: str) -> DataFrame:
    """query_id, chunk_id, score of BM25 over counted postings; statistics: n, mean length and df of each field."""
    asked = np.zeros((len(block), len(terms)))
    known = {t: i for i, t in enumerate(terms.to_pylist())}
    weights = block.column("weights").to_pylist() if "weights" in block.column_names else [None] * len(block)
    for q, (words, own) in enumerate(zip(block.column("terms").to_pylist(), weights, strict=True)):
        for i, w in enumerate(words or []):
            if w is not None:
                asked[q, known[w]] = max(asked[q, known[w]], 1.0 if own is None else own[i])
    idf = [np.log(1 + (n - df + 0.5) / (df + 0.5)) for n, _, df in statistics]
    held = counted.sparkSession.sparkContext.broadcast((_ids(block), asked, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, idf = held.value
        best = Best(k)
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                part = batch.slice(i, SLICE)
                entries = []
                for f, (_, mean, _) in enumerate(statistics):
                    length, term, count = (part.column(f"{a}{f}") for a in "ltc")
                    row = np.repeat(np.arange(len(part)), np.asarray(term.value_lengths()))
                    t, tf, dl = np.asarray(term.flatten()), np.asarray(count.flatten()).astype(float), np.asarray(length)[row]
                    entries.append((row, t, idf[f][t] * tf / (tf + k1 * (1 - b + b * dl / mean)) if len(t) else np.zeros(0)))
                row, term, value = (np.concatenate(x) for x in zip(*entries, strict=True))
                if not len(row):
                    continue
                used, place = np.unique(term, return_inverse=True)
                dense = np.zeros((len(used), len(part)))
                np.add.at(dense, (place, row), value)
                score = asked[:, used] @ dense
                names = np.array(part.column("chunk_id").to_pylist(), object).astype(str)
                best.add_dense(names, np.round(score, 6), score > 0)
        yield from best.told(ids)

    return counted.mapInArrow(run, schema)
