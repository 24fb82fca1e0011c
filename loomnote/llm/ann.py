"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Vectors are scaled to length one, so that the largest inner product is the largest
cosine.  A coarse centre divides the rows into cells, whose number grows with the table;
a vector is its cell's centre plus a remainder.  The remainder's length is kept as it is
and its direction is quantised, so tight cells are told apart as finely as loose ones.
Each pair of dimensions gets sixteen codewords for that, fitted on a bounded sample with
an anisotropic loss: the part of a residual parallel to its vector, which shifts the
inner products with the vector's likely queries, weighs more than the part across it.
A code is four bits a pair of dimensions.

A cell's rows lie in blocks of bounded size, and each query goes to the blocks of its
nearest cells: to as many as hold a share `COVER` of the true neighbours of the sample's
own vectors, found by brute force.  Tight clusters need a few cells; vectors without any
structure need most of them, and the search then costs what a full scan of codes does.  A table holds the product of each query with each codeword; a
scan adds table entries.  The best of a block by the scan are rescored on the original
vectors in double precision, and after them every row whose estimate is within `WIDE`
standard errors of the k-th score.  Both bounds are statistical: a true neighbour can be
missed, as the recall against brute force tells.  Each block hands on k rows a query.

Equal vectors form a class of which the smallest ids alone take part: a query needs no
more than `k + 1` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomnote.llm.shared import Tables

#: Centres and codebooks are fitted on at most so many vectors, those of lowest hash; every row is indexed.
SAMPLE = 20_000
WIDTH = 2
WORDS = 16
#: There is a cell for so many rows, up to one for eight vectors of the sample.
CELL_ROWS = 2048
COVER = 0.97
#: Vectors of the sample whose neighbours decide how many cells a query probes.
TRIED = 256
PARALLEL = 4.0
ROUNDS = 8
#: The best of a block that are rescored first; how many follow depends on their scores.
CANDIDATES = 64
#: Standard errors of an estimate within which a row is rescored too.
WIDE = 4.0
QUERY_BLOCK = 512
CODE_BLOCK = 2048
PAIRS = 16_384
_CELLS = 1 << 24


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no cosine, so that no square is too large or small."""
    _, power = np.frexp(np.abs(rows).max(axis=1, initial=0.0))
    return np.ldexp(rows, -power[:, None])


class Index:
    """Centres, and codebooks (blocks, WORDS, width) for the directions of remainders."""

    def __init__(self, sample: np.ndarray, cells: int = 1, width: int = WIDTH, parallel: float = PARALLEL, rounds: int = ROUNDS):
        self.width, self.parallel = width, parallel
        rows, size = sample.shape
        self.blocks = -(-size // width)
        cells = max(1, min(cells, rows // 8))
        self.centres = sample[np.linspace(0, rows - 1, cells).astype(int)].copy() if rows else np.zeros((1, size))
        for _ in range(rounds if rows else 0):
            near = self.nearest(sample)
            count = np.bincount(near, minlength=cells)
            total = np.zeros_like(self.centres)
            np.add.at(total, near, sample)
            self.centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], self.centres)
        self.books = np.zeros((self.blocks, WORDS, width))
        self.number = 1
        if not rows:
            return
        near, _, direction = self.split(sample)
        self.number = self._needed(sample, near)
        shares, parts = self._cut(sample), self._cut(direction)
        for b in range(self.blocks):
            self.books[b] = self._book(parts[:, b], shares[:, b], rounds)

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        return self.probes(rows, 1)[:, 0]

    def probes(self, rows: np.ndarray, number: int) -> np.ndarray:
        """The numbers of each row's nearest centres (in no order)."""
        number = min(number, len(self.centres))
        found = np.zeros((len(rows), number), np.int64)
        square = (self.centres**2).sum(axis=1)
        for i in range(0, len(rows), 1024):
            far = square - 2 * rows[i : i + 1024] @ self.centres.T
            found[i : i + 1024] = np.argpartition(far, number - 1, axis=1)[:, :number]
        return found

    def split(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's centre, and its remainder's length and direction."""
        near = self.nearest(rows)
        rest = rows - self.centres[near]
        length = np.linalg.norm(rest, axis=1)
        return near, length, rest / np.maximum(length, 1e-12)[:, None]

    def _needed(self, sample: np.ndarray, near: np.ndarray, k: int = 5) -> int:
        """How many nearest cells hold the share COVER of the nearest vectors, over some of the sample."""
        tried = np.unique(np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int))
        product = sample[tried] @ sample.T
        product[np.arange(len(tried)), tried] = -np.inf
        best = np.argpartition(-product, min(k, len(sample) - 1), axis=1)[:, : min(k, len(sample) - 1)]
        far = (self.centres**2).sum(axis=1) - 2 * sample[tried] @ self.centres.T
        place = np.take_along_axis(np.argsort(np.argsort(far, axis=1), axis=1), near[best], axis=1).ravel()
        return int(np.sort(place)[int(np.ceil(COVER * len(place))) - 1]) + 1 if len(place) else 1

    def _cut(self, rows: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(rows), self.blocks * self.width))
        padded[:, : rows.shape[1]] = rows
        return padded.reshape(len(rows), self.blocks, self.width)

    def _book(self, part: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
        """Lloyd's method under |r|^2 + (parallel - 1) * (r . x)^2, r a residual, x the vector's share."""
        order = np.argsort(np.arctan2(part[:, -1], part[:, 0]), kind="stable")
        book = part[order[np.linspace(0, len(part) - 1, WORDS).astype(int)]].copy()
        metric = np.eye(self.width) + (self.parallel - 1) * share[:, :, None] * share[:, None, :]
        for _ in range(rounds):
            chosen = self._choose(part, share, book)
            for w in np.unique(chosen):
                own = chosen == w
                book[w] = np.linalg.solve(metric[own].sum(axis=0), np.einsum("nij,nj->i", metric[own], part[own]))
        return book

    def _choose(self, part: np.ndarray, share: np.ndarray, book: np.ndarray) -> np.ndarray:
        residual = part[:, None, :] - book[None]
        along = np.einsum("nwd,nd->nw", residual, share)
        return ((residual**2).sum(axis=2) + (self.parallel - 1) * along**2).argmin(axis=1)

    def encode(self, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remainder's length, length of what the code leaves of it, and codes, two a byte."""
        rest = rows - self.centres[near]
        length = np.linalg.norm(rest, axis=1)
        parts, shares = self._cut(rest / np.maximum(length, 1e-12)[:, None]), self._cut(rows)
        codes = np.stack([self._choose(parts[:, b], shares[:, b], self.books[b]) for b in range(self.blocks)], axis=1).astype(np.uint8)
        left = ((parts - self.books[np.arange(self.blocks), codes]) ** 2).sum(axis=(1, 2))
        if self.blocks % 2:
            codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
        return length.astype(np.float32), (length * np.sqrt(left)).astype(np.float32), codes[:, ::2] << 4 | codes[:, 1::2]

    def scan(self, queries: np.ndarray, cell: int, length: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated products (queries, rows of a cell), two four-bit look-ups a byte of code."""
        table = np.einsum("qbd,bwd->bqw", self._cut(queries), self.books).astype(np.float32)
        if self.blocks % 2:
            table = np.concatenate([table, np.zeros_like(table[:1])])
        out = np.zeros((len(queries), len(codes)), np.float32)
        for b in range(codes.shape[1]):
            both = (table[2 * b][:, :, None] + table[2 * b + 1][:, None, :]).reshape(len(queries), WORDS * WORDS)
            out += both[:, codes[:, b]]
        return out * length + (queries @ self.centres[cell]).astype(np.float32)[:, None]


def by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a column of vectors each length, the rows that have it, and their values, scaled."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, scaled(flat[starts[rows][:, None] + np.arange(size)])


class Space:
    """An index for each length of vectors in the sample; other lengths form one cell each."""

    def __init__(self, sample: pa.Array, total: int):
        self.by: dict[int, Index] = {}
        for size, rows, data in by_size(sample):
            share = total * len(rows) // len(sample)
            self.by[size] = Index(unit(data), -(-share // CELL_ROWS))

    def of(self, size: int) -> Index:
        return self.by.get(size) or Index(np.zeros((0, size)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<double>) of the rows that can be compared, one a row of the table.

    Rows with a null id or vector, an empty or zero vector, or a component that is null,
    NaN or infinite take no part.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(fine & F.exists("x", lambda v: v != 0))


def cosine(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (q * y).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _numbers(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def nearest_of_block(index: Index, cell: int, k: int, asked: tuple[np.ndarray, ...], block: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """Query row, vec_id and score of each query's k best rows of a block.

    asked: the queries' row numbers and vectors; block: row numbers, vec_ids, remainder
    lengths, error lengths, codes and vectors.
    """
    rows, ids, length, error, codes, y = block
    slack = WIDE / np.sqrt(y.shape[1]) * error + 1e-6
    for at in range(0, len(asked[0]), 64):
        own, q = asked[0][at : at + 64], asked[1][at : at + 64]
        estimate = index.scan(unit(q), cell, length, codes)
        other = own[:, None] != rows[None]
        estimate[~other] = -np.inf
        first = np.argpartition(-estimate, min(CANDIDATES, len(rows)) - 1, axis=1)[:, :CANDIDATES]
        near = np.zeros(estimate.shape, bool)
        np.put_along_axis(near, first, True, axis=1)
        score = np.full(estimate.shape, -np.inf)

        def rescore(chosen: np.ndarray, q=q, score=score) -> None:
            one, two = np.nonzero(chosen)
            for i in range(0, len(one), PAIRS):
                a, b = one[i : i + PAIRS], two[i : i + PAIRS]
                score[a, b] = cosine(q[a], y[b])

        rescore(near & other)
        least = -np.partition(-score, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
        rescore((estimate + slack >= least[:, None]) & other & ~near)
        least = -np.partition(-score, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
        one, two = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        order = np.lexsort((rows[two], ids[two], -score[one, two], one))
        one, two = one[order], two[order]
        place = np.arange(len(one)) - np.searchsorted(one, one)
        one, two = one[place < k], two[place < k]
        yield own[one], ids[two], score[one, two]


def search(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50, probes: int | None = None) -> DataFrame:
    """Each query's k nearest: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; a query's own row is no
    candidate for it.  Fewer candidates than k give fewer rows.  Rows that share a vec_id
    are searched and found one by one, each a candidate for the others.  Vectors are
    compared with those of their own length only.  Other columns are ignored; an empty
    table gives no rows.  `probes` is the number of cells a query goes to; by default the
    sample decides.
    """
    tables = Tables(spark)
    rows = tables.write(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "rows")
    # of equal vectors the k + 1 smallest ids; the window limit applies before the shuffle
    place = Window.partitionBy("x").orderBy("vec_id", "row")
    leaders = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).drop("place")
    leaders = tables.write(leaders, "leaders")
    sample = leaders.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("x").toArrow().column("x").combine_chunks()
    sample = pa.concat_arrays(sample.chunks) if isinstance(sample, pa.ChunkedArray) else sample
    held = spark.sparkContext.broadcast(Space(sample, leaders.count()))

    def route(number: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, own, data in by_size(batch.column("x")):
                    index = held.value.of(size)
                    cells = index.probes(unit(data), number or index.number)
                    taken = batch.take(pa.array(np.repeat(own, cells.shape[1])))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.ravel() + size * _CELLS)], names=["vec_id", "x", "row", "cell"])

        return run

    routed = "vec_id long, x array<double>, row long, cell long"
    placed = tables.write(leaders.mapInArrow(route(1), routed), "placed")
    asked = tables.write(rows.where(F.col("vec_id") % every == 0).mapInArrow(route(probes), routed), "asked")

    def parts(table: DataFrame, most: int, name: str) -> DataFrame:
        return table.groupBy("cell").agg(F.ceil(F.count("row") / most).cast("int").alias(name))

    shape = tables.write(parts(placed, CODE_BLOCK, "blocks").join(parts(asked, QUERY_BLOCK, "lists"), "cell", "left"), "shape")

    def encode(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        ((size, _, data),) = by_size(group.column("x").combine_chunks())
        parts = held.value.of(size).encode(unit(data), np.full(len(data), cell % _CELLS))
        ids = [np.asarray(group.column(c)).astype(np.int64) for c in ("row", "vec_id")]
        return pa.table([pa.array([cell]), group.column("lists")[:1], *_binary(*ids, *parts, data)], names=["cell", "lists", "rows", "ids", "length", "error", "codes", "y"])

    def gather(group: pa.Table) -> pa.Table:
        ((_, _, data),) = by_size(group.column("x").combine_chunks())
        return pa.table([group.column("cell")[:1], group.column("list")[:1], *_binary(np.asarray(group.column("row")).astype(np.int64), data)], names=["cell", "list", "queries", "q"])

    def dealt(number: str):
        return F.pmod(F.xxhash64("row"), F.col(number)).cast("int")

    blocks = placed.join(shape, "cell").withColumn("block", dealt("blocks"))
    blocks = blocks.groupBy("cell", "block").applyInArrow(encode, "cell long, lists int, rows binary, ids binary, length binary, error binary, codes binary, y binary")
    blocks = tables.write(blocks, "blocks")
    lists = asked.join(shape, "cell").withColumn("list", dealt("lists"))
    lists = tables.write(lists.groupBy("cell", "list").applyInArrow(gather, "cell long, list int, queries binary, q binary"), "lists")
    # each block of a cell meets each list of the queries that probe the cell once
    met = blocks.where("lists is not null").withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).join(lists, ["cell", "list"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, *block, queries, q in zip(*batch.columns, strict=True):
                size, number = divmod(cell.as_py(), _CELLS)
                kinds = (np.int64, np.int64, np.float32, np.float32, np.uint8, np.float64)
                rows, ids, length, error, codes, y = (_numbers(b, kind) for b, kind in zip(block, kinds, strict=True))
                own = rows, ids, length, error, codes.reshape(len(rows), -1), y.reshape(len(rows), size)
                asked = _numbers(queries, np.int64), _numbers(q, np.float64).reshape(-1, size)
                for found in nearest_of_block(held.value.of(size), number, k, asked, own):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query", "vec_id", "score"])

    found = met.select("cell", "rows", "ids", "length", "error", "codes", "y", "queries", "q").mapInArrow(best, "query long, vec_id long, score double")
    final = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    names = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return tables.finish(ranked.join(names, "query").select("query_id", "rank", "vec_id", "score"))
