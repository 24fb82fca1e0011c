"""Source divergence audit: how each source's words differ from every other source of its language.

A language keeps the terms that stand in at least `MIN_DOCUMENTS` of its documents.  A
group (language, source) gives each of them a share, with one added to every count, in
whole billionths, and two groups differ by the sum over all terms of (p - q)^2 / q,
rounded down term by term.  All arithmetic is on whole numbers.

That sum over all terms for all pairs of groups is split by how many groups hold a term:

* Heavy terms, held by many groups, go in tiles of terms times groups to numpy, which
  takes every pair of the tile's columns.
* Light terms are held by few.  A group without a term gives it the same share p0 whatever
  the term, so the sum over the light terms is that of two empty groups, corrected
  (1) for each group by its terms' counts, against every other group's p0 (terms of one
  count are one entry) and (2) for each pair of groups in a term's posting list, for what
  the two corrections of (1) miss where both hold the term.

Both partial sums are whole numbers, so that their sum is that of all terms exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomnote.llm import bytetext as bt
from loomnote.llm.shared import Tables

MIN_DOCUMENTS = 3
UNIT = 1_000_000_000
TOP_TERMS = 200
#: A term is light if no more than a third of the language's groups, and so many, hold it.
#: (The bound keeps posting lists small; terms beyond it are in tiles.)
MOST_POSTINGS = 2000
#: Terms and groups of a tile, counts of a unit of corrections, pairs held at once.
TILE_TERMS, TILE_GROUPS, UNIT_COUNTS, PAIRS = 1000, 256, 50_000, 1_000_000
#: So many groups, some 100 bytes each, are broadcast; beyond it they are joined by shuffles.
FEW_GROUPS = 100_000
#: Letters (after LOWER) and all that is not ASCII.
LETTERS = bt.byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])
_PARTIAL = "lang string, g long, h long, value long"


def terms_of(chunk: bt.Chunk) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunk's distinct terms, and of each word its term and its document."""
    data = bt.LOWER[chunk.data]
    found = bt.words(chunk, LETTERS, data)
    size = found.end - found.start
    ends = np.cumsum(size)
    flat = data[np.repeat(found.start - (ends - size), size) + np.arange(int(size.sum()))]
    offsets = np.concatenate([[0], ends])
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat))
    coded = words.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), found.owner()


def _merged(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
    return whole.rename_columns({"count_sum": "count", "docs_sum": "docs"}).select(_COUNTS.names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, added up over many batches of a task."""
    parts: list[pa.Table] = []
    rows = 0
    for batch in batches:
        langs, sources = (pc.fill_null(batch.column(c), "").dictionary_encode() for c in ("lang", "source"))
        width = max(1, len(sources.dictionary))
        group = np.asarray(langs.indices).astype(np.int64) * width + np.asarray(sources.indices)
        for chunk in bt.chunks(batch.column("text")):
            terms, code, row = terms_of(chunk)
            n = max(1, len(terms))
            pairs, count = np.unique(row * n + code, return_counts=True)
            owner, term = np.divmod(pairs, n)
            cells, which = np.unique(group[chunk.first + owner] * n + term, return_inverse=True)
            own, term = np.divmod(cells, n)
            sums = np.zeros(len(cells), np.int64)
            np.add.at(sums, which, count)
            parts.append(
                pa.table(
                    [langs.dictionary.take(pa.array(own // width)), sources.dictionary.take(pa.array(own % width)), terms.take(pa.array(term)).cast(pa.string()), pa.array(sums), pa.array(np.bincount(which, minlength=len(cells)).astype(np.int64))],
                    schema=_COUNTS,
                )
            )
            rows += len(cells)
            if rows > 600_000:
                parts = [_merged(parts)]
                rows = len(parts[0])
                if rows > 300_000:
                    yield from parts[0].to_batches(max_chunksize=50_000)
                    parts, rows = [], 0
    if parts:
        yield from _merged(parts).to_batches(max_chunksize=50_000)
    bt.release()


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division, so that no product leaves 64 bits."""
    total = np.maximum(total, 1)
    rest, out = np.broadcast_arrays(np.asarray(count) + 1, total)[0].copy(), 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Unit:
    """Two blocks of groups, whose pairs are added up in a matrix."""

    def __init__(self, key: tuple, groups: pa.Table):
        self.lang, self.tile, one, two = (k.as_py() for k in key)
        order = groups.sort_by("g")
        self.g = np.asarray(order.column("g").combine_chunks())
        self.total = np.asarray(order.column("total").combine_chunks())
        #: The number of terms that this unit is about.
        self.terms = int(order.column("about")[0].as_py()) if len(order) else 0
        block = np.asarray(order.column("block").combine_chunks())
        self.sides = [np.flatnonzero(block == one), np.flatnonzero(block == two)]
        self.same = one == two
        self.value = np.zeros((len(self.g), len(self.g)), np.int64)

    def place(self, g: pa.ChunkedArray) -> np.ndarray:
        return np.searchsorted(self.g, np.asarray(g.combine_chunks()))

    def directions(self) -> list[tuple[np.ndarray, np.ndarray]]:
        a, b = self.sides
        return [(a, b)] if self.same else [(a, b), (b, a)]

    def add_empty(self, terms: int) -> None:
        """Terms that neither of two groups holds."""
        nothing = share(np.zeros(len(self.g), np.int64), self.total)
        self.value += terms * distance(nothing[:, None], nothing[None, :])

    def rows(self) -> pa.Table:
        one, two = (np.concatenate(x) for x in zip(*((np.repeat(i, len(j)), np.tile(j, len(i))) for i, j in self.directions()), strict=True))
        other = one != two
        one, two = one[other], two[other]
        return pa.table({"lang": pa.array([self.lang] * len(one), pa.string()), "g": self.g[one], "h": self.g[two], "value": self.value[one, two]})


def _dense(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """A tile of heavy terms: every pair of its groups, over all of its terms."""
    unit = _Unit(key, groups)
    coded = cells.column("term").combine_chunks().dictionary_encode()
    count = np.zeros((len(coded.dictionary), len(unit.g)), np.int64)
    count[np.asarray(coded.indices), unit.place(cells.column("g"))] = np.asarray(cells.column("count").combine_chunks())
    p = share(count, unit.total[None, :])
    for ours, theirs in unit.directions():
        q = p[:, theirs]
        for i in ours.tolist():
            unit.value[i, theirs] = distance(p[:, i : i + 1], q).sum(axis=0)
    unit.add_empty(unit.terms - len(count))  # those that no group of these blocks holds
    return unit.rows()


def _single(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Light terms, as far as one group alone tells: `n` terms of group g with some count, against groups without them."""
    unit = _Unit(key, groups)
    nothing = share(np.zeros(len(unit.g), np.int64), unit.total)
    if unit.tile == 0:
        unit.add_empty(unit.terms)
    own = unit.place(cells.column("g"))
    count, n = (np.asarray(cells.column(c).combine_chunks()) for c in ("count", "n"))
    side = np.isin(own, unit.sides[0])
    for ours, theirs in unit.directions():
        chosen = np.flatnonzero(side if ours is unit.sides[0] else ~side)
        for i in range(0, len(chosen), 2000):
            part = chosen[i : i + 2000]
            g, many = own[part], n[part, None]
            p, empty, other = share(count[part], unit.total[g])[:, None], nothing[g, None], nothing[None, theirs]
            np.add.at(unit.value, (g[:, None], theirs[None, :]), many * (distance(p, other) - distance(empty, other)))
            np.add.at(unit.value, (theirs[None, :], g[:, None]), many * (distance(other, p) - distance(other, empty)))
    return unit.rows()


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of light terms: what each pair in one adds to the two groups' own corrections."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (code, value) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code >> 32), pa.array(code & 0xFFFFFFFF), pa.array(value)], names=["lang", "g", "h", "value"])
        sums.clear()

    def add(lang: str, code: np.ndarray, value: np.ndarray) -> None:
        if lang in sums:
            code, value = np.concatenate([sums[lang][0], code]), np.concatenate([sums[lang][1], value])
        kinds, which = np.unique(code, return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, which, value)
        sums[lang] = kinds, total

    for batch in batches:
        lists = batch.column("postings")
        size, flat = np.asarray(lists.value_lengths()).astype(np.int64), lists.flatten()
        g, count, total = (np.asarray(flat.field(c)) for c in ("g", "count", "total"))
        start = np.cumsum(size) - size
        langs = batch.column("lang").dictionary_encode()
        lang = np.asarray(langs.indices)
        for k, code in np.unique(np.stack([size, lang]), axis=1).T.tolist():
            rows = np.flatnonzero((size == k) & (lang == code))
            step = max(1, PAIRS // (k * k))
            for i in range(0, len(rows), step):
                at = start[rows[i : i + step], None] + np.arange(k)
                p, empty = share(count[at], total[at]), share(np.zeros(at.shape, np.int64), total[at])
                p, q, p0, q0 = p[:, :, None], p[:, None, :], empty[:, :, None], empty[:, None, :]
                value = distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)
                pair = g[at][:, :, None] << 32 | g[at][:, None, :]
                other = np.broadcast_to(~np.eye(k, dtype=bool), value.shape)
                add(langs.dictionary[code].as_py(), pair[other], value[other])
        if sum(len(x[0]) for x in sums.values()) > PAIRS:
            yield from out()
    yield from out()


def _blocked(rows: DataFrame) -> DataFrame:
    """Each row once for every block of groups that its own block meets, keyed by both blocks."""
    other = F.explode(F.expr(f"sequence(0L, (groups - 1) div {TILE_GROUPS})"))
    both = rows.withColumn("block", F.expr(f"g div {TILE_GROUPS}")).withColumn("other", other)
    return both.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "groups")


def _share(count: str, total: str) -> str:
    return f"(1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} as decimal(20,0)))"


def audit(spark: SparkSession, documents: DataFrame, top_terms: int = TOP_TERMS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, by how much it differs.  Part `term`:
    the first `top_terms` of the terms that the source has more of than its language.  Null
    lang, source and text are read as empty; every row is a document of its own, whatever
    its doc_id; a group whose texts have no terms, or an empty text, counts as a group
    without occurrences.  Long texts are read whole.  Equal values are ranked by item in
    UTF-8 order.  Other columns are ignored; an empty table gives no rows.
    """
    tables = Tables(spark)
    plain = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    made = plain.mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    counts = tables.write(made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("everywhere"), F.count("source").alias("holders"))
    kept = tables.write(kept.where(F.col("docs") >= min_documents).drop("docs"), "kept")
    cells = tables.write(counts.drop("docs").join(kept, ["lang", "term"]), "cells")
    tables.drop("counts")

    # groups and languages with their sums
    named = plain.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("count").alias("own")), ["lang", "source"], "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    named = tables.write(named.select("lang", "source", F.coalesce("own", F.lit(0)).alias("own"), number.alias("g")), "named")
    vocabulary = kept.groupBy("lang").agg(F.count("term").alias("terms"), F.sum("everywhere").alias("words"))
    langs = named.groupBy("lang").agg(F.count("g").alias("groups")).join(vocabulary, "lang", "left").fillna(0, ["terms", "words"])
    langs = langs.withColumn("most", F.expr(f"least(groups div 3, {MOST_POSTINGS})"))
    few = named.count() <= FEW_GROUPS
    small = F.broadcast if few else (lambda frame: frame)
    heavy = kept.join(small(langs.select("lang", "most")), "lang").groupBy("lang").agg(F.count_if(F.col("holders") > F.col("most")).alias("heavy"))
    langs = tables.write(langs.join(heavy, "lang", "left").fillna(0, ["heavy"]).withColumn("light", F.expr("terms - heavy")), "langs")
    groups = named.join(small(langs), "lang").withColumn("total", F.expr("own + terms")).drop("own")
    groups = tables.write(groups, "groups")
    tables.drop("named")
    cells = cells.join(small(groups.select("lang", "source", "g", "total", "groups", "most", "terms", "words", "heavy")), ["lang", "source"])

    # terms that a source has more of than its language
    shares = cells.selectExpr("lang", "source", "term as item", f"{_share('count', 'total')} as p", f"{_share('everywhere', '(words + terms)')} as q").where("p > q")
    shares = shares.selectExpr("lang", "source", "'term' as part", "item", "(p - q) * (p - q) div q as value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = shares.withColumn("rank", place).where(F.col("rank") <= top_terms)

    # heavy terms in tiles
    stats = ["lang", "g", "total", "groups", "light"]
    stats = groups.select(*stats).toDF(*stats)  # columns of its own, to be grouped beside those of the cells
    tile = F.pmod(F.xxhash64("term"), F.expr(f"greatest((heavy + {TILE_TERMS - 1}) div {TILE_TERMS}, 1L)")).alias("tile")
    unit = ["lang", "tile", "one", "two"]
    dense = _blocked(cells.where("holders > most").select("lang", tile, "term", "g", "count", "groups"))
    tiles = kept.join(small(langs.select("lang", "most", "heavy")), "lang").where("holders > most").groupBy("lang", tile).agg(F.count("term").alias("about"))
    seen = _blocked(stats.drop("light").join(tiles, "lang"))
    partial = [dense.groupBy(*unit).cogroup(seen.groupBy(*unit)).applyInArrow(_dense, _PARTIAL)]

    # light terms: by counts, and by posting lists
    light = cells.where("holders <= most")
    counted = tables.write(light.groupBy("lang", "g", "groups", "count").agg(F.count("term").alias("n")), "counted")
    units = counted.groupBy("lang").agg(F.expr(f"(count(*) + {UNIT_COUNTS - 1}) div {UNIT_COUNTS}").alias("units"))
    tile = F.pmod(F.xxhash64("g", "count"), F.col("units")).alias("tile")
    single = _blocked(counted.join(small(units), "lang").select("lang", tile, "g", "count", "n", "groups"))
    seen = stats.join(small(units), "lang", "left").withColumn("tile", F.explode(F.expr("sequence(0L, coalesce(units, 1L) - 1)"))).drop("units").withColumnRenamed("light", "about")
    partial.append(single.groupBy(*unit).cogroup(_blocked(seen).groupBy(*unit)).applyInArrow(_single, _PARTIAL))
    lists = light.where("holders > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("g", "count", "total")).alias("postings")).drop("term")
    partial.append(lists.mapInArrow(_both, _PARTIAL))

    whole = tables.write(partial[0].unionAll(partial[1]).unionAll(partial[2]).groupBy("lang", "g", "h").agg(F.sum("value").alias("value")), "whole")
    names = groups.select("lang", "g", "source")
    pairs = whole.join(small(names), ["lang", "g"]).join(small(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))), ["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    return tables.finish(pairs.unionAll(terms))
