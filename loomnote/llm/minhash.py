"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

A document's set is its distinct runs of five words.  SuperMinHash gives every element a
random permutation of the signature's slots and lets slot `p(j)` see the value `j + r`;
the ranks j of one element differ between slots, which makes the signature's variance
lower than that of independent minima.  All elements of many documents take step j
together, and a document leaves as soon as every slot holds a value below j + 1, which no
later step can lower: for most documents after one or two steps.

Documents with equal sets, told by a digest of the whole set, form a class; only its smallest doc_id goes on.  Classes that
agree in a band of the signature are candidates.  Band keys travel with ids alone; what
tells pairs apart, a sketch of the set, is joined to the few ids whose keys are shared.
Within a bucket each class is first checked against the smallest; buckets
whose classes those links do not join into one component are then searched in full, but
only across components, since a link within a component changes nothing.  Every link is
confirmed on the full sets, each of which is shuffled once for all of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import bytetext as bt
from loomnote.llm.components import components
from loomnote.llm.shared import Tables, narrowed

SHINGLE = 5
SLOTS = 128
BANDS = 32
PERCENT = 75
#: Words of 64 parities: each element turns one of them over.  Sets that differ in d elements
#: differ in d parities at most, so a pair with more differing parities than a link allows
#: cannot be one.  This bound is never wrong, and sharp for sets of up to some 1000 elements.
PARITIES = 8
MARKS = [f"o{i}" for i in range(PARITIES)]
#: A set is read once for so many comparisons; a class with more gets several rows.
MOST_OTHERS = 500
_TOP = np.uint64(56)
_FREE = np.uint64((1 << 64) - 1)
_ACTIVE_BYTES = 8 << 20


def shingles(chunk: bt.Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document of a chunk, and where each one's begin."""
    data = bt.LOWER[chunk.data]
    spans = bt.words(chunk, bt.NON_SPACE, data)
    hashes = bt.span_hash(data, spans.start, spans.end)
    owner, left, count = spans.owner(), spans.left(), spans.per_row
    full = np.flatnonzero(left >= size)
    parts, owners = [bt.run_hash(hashes, size)[full] if len(full) else np.zeros(0, np.uint64)], [owner[full]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            first = spans.row[short]
            runs = hashes[first[:, None] + np.arange(n)]
            parts.append(np.array([bt.run_hash(run, n)[0] for run in runs], np.uint64) ^ np.uint64(n))
            owners.append(short)
    value, row = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(chunk.rows + 1))


def _draw(elements: np.ndarray, step: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Each element's fraction (56 bits) and its place among the slots not yet seen, at a step."""
    x = bt.mix(elements + np.uint64((step * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    place = step + ((x & np.uint64(0xFFFFFF)) * np.uint64(slots - step) >> np.uint64(24)).astype(np.int64)
    return x >> np.uint64(8), place


def signatures(elements: np.ndarray, starts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One SuperMinHash signature a document: step in the top byte, fraction below it."""
    rows = len(starts) - 1
    out = np.full((rows, slots), _FREE)
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(rows), sizes)
    fraction, place = _draw(elements, 0, slots)
    np.minimum.at(out.reshape(-1), owner * slots + place, fraction)
    open_rows = np.flatnonzero((sizes > 0) & (out == _FREE).any(axis=1))
    i = 0
    while i < len(open_rows):
        total = np.cumsum(sizes[open_rows[i:]])
        j = i + max(1, int(np.searchsorted(total, _ACTIVE_BYTES // slots, "right")))
        _finish(out, elements, starts, open_rows[i:j], slots)
        i = j
    return out


def _finish(out: np.ndarray, elements: np.ndarray, starts: np.ndarray, rows: np.ndarray, slots: int) -> None:
    """Further steps for the documents with slots that no first step has reached."""
    sizes = starts[rows + 1] - starts[rows]
    owner = np.repeat(rows, sizes)
    own = elements[np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(own), 1))
    which = np.arange(len(own))
    for step in range(slots):
        fraction, place = _draw(own, step, slots)
        slot = order[which, place].astype(np.int64)
        order[which, place] = order[which, step]
        order[which, step] = slot
        if step:
            np.minimum.at(out.reshape(-1), owner * slots + slot, fraction | np.uint64(step) << _TOP)
        still = (out[rows] >> _TOP).max(axis=1) > step
        if not still.any():
            return
        if not still.all():
            keep = np.isin(owner, rows[still])
            rows, owner, own, order = rows[still], owner[keep], own[keep], order[keep]
            which = np.arange(len(own))


def bands(signature: np.ndarray, number: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows, slots = signature.shape
    parts = signature.reshape(rows, number, slots // number)
    key = np.zeros((rows, number), np.uint64) + np.arange(1, number + 1, dtype=np.uint64)
    for i in range(slots // number):
        key = bt.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def parities(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Odd sketches: per document PARITIES words in which each element turns one bit over."""
    rows = len(starts) - 1
    out = np.zeros(rows * PARITIES, np.uint64)
    place = bt.mix(elements ^ np.uint64(0x51ED270B))
    owner = np.repeat(np.arange(rows), np.diff(starts))
    np.bitwise_xor.at(out, owner * PARITIES + (place >> np.uint64(61)).astype(np.int64) % PARITIES, np.uint64(1) << (place & np.uint64(63)))
    return out.reshape(rows, PARITIES)


def _may_link(one: str, two: str) -> str:
    """SQL for what every link fulfils, over the columns n and MARKS of two sides."""
    odd = " + ".join(f"bit_count({m}{one} ^ {m}{two})" for m in MARKS)
    sizes = f"100 * least(n{one}, n{two}) >= {PERCENT} * greatest(n{one}, n{two})"
    # 100 i >= P (a + b - i) gives a + b - 2 i <= (100 - P) (a + b) / (100 + P)
    return f"{sizes} and {100 + PERCENT} * ({odd}) <= {100 - PERCENT} * (n{one} + n{two})"


def _side(rows: DataFrame, mark: str, *more: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}{mark}") for c in ("id", "n", *MARKS, *more)))


def _digests(elements: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """A cryptographic digest of each document's whole sorted set, in two halves."""
    data, cut = elements.tobytes(), (8 * starts).tolist()
    made = b"".join([blake2b(data[s:e], digest_size=16).digest() for s, e in zip(cut, cut[1:], strict=False)])
    both = np.frombuffer(made, np.uint64).reshape(-1, 2)
    return [np.ascontiguousarray(both[:, i]) for i in range(2)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in bt.chunks(batch.column("text")):
            elements, starts = shingles(chunk)
            sizes = np.diff(starts)
            one, two = _digests(elements, starts)
            signed = signatures(elements, starts)
            keys = bands(signed).view(np.int64)
            odd = parities(elements, starts).view(np.int64)
            filled = sizes > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled * BANDS)]), pa.int32()), pa.array(keys[filled].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first, chunk.rows), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITIES)), lists],
                names=["doc_id", "n", "s1", "s2", *MARKS, "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's set, beside the list of the classes it is compared with."""
    for batch in batches:
        for chunk in bt.chunks(batch.column("text")):
            elements, starts = shingles(chunk)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(elements.view(np.int64)))
            same = [batch.column(c).slice(chunk.first, chunk.rows) for c in ("doc_id", "others")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.diff(starts)), lists], names=["doc_id", "others", "n", "elements"])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _confirm(pairs: DataFrame, texts: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Of the pairs (a, b) of classes those whose full sets are similar enough, as edges (u, v).

    Rows that share the id of a class are all compared, since the id has the links of each.
    """
    pairs = tables.write(pairs, f"{name}-pairs")
    each = pairs.groupBy("b").agg(F.ceil(F.count("a") / MOST_OTHERS).alias("parts"))
    dealt = pairs.join(each, "b").groupBy("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    members = dealt.agg(F.collect_set("a").alias("others")).select(F.col("b").alias("doc_id"), "others")
    pivots = pairs.select(F.col("a").alias("doc_id")).distinct().withColumn("others", F.lit(None).cast("array<long>"))
    asked = tables.write(members.unionAll(pivots), f"{name}-asked")
    rows = narrowed(texts, asked, "doc_id").join(asked, "doc_id").select("doc_id", "others", "text")
    sets = tables.write(rows.mapInArrow(_sets, "doc_id long, others array<long>, n long, elements array<long>"), f"{name}-sets")
    one = sets.where("others is null").select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    two = sets.select(F.explode("others").alias("a"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    joined = two.join(one, "a").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    common = F.size(F.array_intersect("ea", "eb")).cast("long")
    links = joined.select("a", "b", "na", "nb", common.alias("common")).where(100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common")))
    out = tables.write(links.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}-links")
    for part in ("asked", "sets"):
        tables.drop(f"{name}-{part}")
    return out


def near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no set and stand alone.  Rows that share a doc_id count as
    one document that has the links of each; a null doc_id stands alone with a null
    component and is kept.  Other columns are ignored; an empty table gives no rows.
    """
    tables = Tables(spark)
    texts = _texts(documents)
    marks = ", ".join(f"{m} long" for m in MARKS)
    sketch = tables.write(texts.mapInArrow(_sketch, f"doc_id long, n long, s1 long, s2 long, {marks}, bands array<long>"), "sketch")
    same = ["n", "s1", "s2"]
    real = sketch.where("n > 0 and doc_id is not null")
    classes = real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    copies = real.select("doc_id", *same).join(classes, same).where("doc_id <> rep")
    copies = tables.write(copies.distinct(), "copies")
    reps = real.join(copies.select("doc_id", *same), ["doc_id", *same], "left_anti")
    # keys and ids alone: merged at every size, since either side grows with the documents
    buckets = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    shared = buckets.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot < other").drop("other")
    full = tables.write(buckets.join(shared.hint("merge"), "key"), "full")
    wanted = full.select("id").distinct()
    rest = tables.write(reps.select(F.col("doc_id").alias("id"), "n", *MARKS).join(wanted, "id", "left_semi"), "marks")
    pairs = full.where("id > pivot").select(F.col("pivot").alias("id_a"), F.col("id").alias("id_b")).distinct()
    near = pairs.join(_side(rest, "_b"), "id_b").join(_side(rest, "_a"), "id_a").where(_may_link("_a", "_b"))
    first = near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    links = _confirm(first, texts, tables, "first")
    labels = tables.write(components(links, tables, "grow"), "labels")
    # buckets that hold several components still: every pair across components
    known = full.join(labels, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).select("key", "id", "c")
    known = tables.write(known, "known")
    counted = known.groupBy("key", "c").agg(F.count("id").alias("size"))
    mixed = counted.groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("c").alias("several")).where("several > 1").drop("several")
    rows = tables.write(known.join(mixed, "key").join(rest, "id"), "mixed")
    one, two = _side(rows.where("c <> main"), "_a", "key", "c"), _side(rows, "_b", "key", "c", "main")
    across = one.join(two, F.expr(f"key_a = key_b and c_a <> c_b and (c_b = main_b or id_a < id_b) and {_may_link('_a', '_b')}"))
    second = across.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    second = second.join(spark.read.parquet(f"{tables.root}/first-pairs"), ["a", "b"], "left_anti")
    more = _confirm(second, texts, tables, "second")
    edges = links.unionAll(more).unionAll(copies.select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    for name in ("full", "marks", "known", "mixed", "labels"):
        tables.drop(name)
    final = tables.write(components(edges, tables, "final"), "final")
    result = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return tables.finish(result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
