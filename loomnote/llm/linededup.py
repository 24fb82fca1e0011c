"""Line dedup: a line goes if an earlier one is equal or one edit away; the earliest stays.

Every line counts that is not blank; empty lines and lines of white space only always
stay, and nothing is compared with them.  Earlier means a smaller doc_id, or the same and
a smaller line number.  An edit is one character put in, left out or exchanged.

1. Equal lines are grouped by a 128-bit cryptographic digest; only the earliest of each goes on.
2. One edit leaves three of a line's four blocks as they are.  Each line emits four
   keys, one without each block; a line that shares none of them has no neighbour.
3. For a shared key, the left-out block is cut in four again: of the lines that share a
   block key each emits four finer keys, which leave a sixteenth of the line out.  Lines of
   many words that differ in a whole word part here, before anything is emitted by character.
4. The others emit, for a shared finer key, every variant of the left-out part that lacks one
   character, with its place for an exchange and without for an insertion.  Equal variants
   are joined; each line is compared with the earliest one of each variant only, which is
   enough, as all lines of a variant are neighbours.
5. Lines of fewer than `BLOCK_CHARS` characters have no four blocks.  Their text is carried
   along and each emits the variants of the whole line.
6. Pairs are confirmed by the edit distance of the lines themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import bytetext as bt
from loomnote.llm.shared import Tables, fresh, narrowed, quoted

#: No line is too short, but blank lines do not count.
MIN_CHARS = 1
BLOCKS = 4
#: If the longer line of a pair has so many characters, each of its blocks has four at least.
BLOCK_CHARS = 4 * BLOCKS
REBUILT_ROWS = 500
_K = [np.uint64(bt.mix_int(i + 77)) | np.uint64(1) for i in range(6)]
#: White space by code point; the last entry stands for all higher ones.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
#: The key of short lines, of which no block is left.
_WHOLE = np.uint64(bt.mix_int(83))


class Lines:
    """The lines of a chunk's documents, in characters."""

    def __init__(self, chunk: bt.Chunk):
        data = chunk.data
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        self.text = data.tobytes().decode("utf-8")
        self.chars = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        bounds = np.searchsorted(lead, chunk.starts)
        rows = chunk.rows
        feeds = np.flatnonzero(self.chars == 10)
        row_of_feed = np.searchsorted(bounds, feeds, "right") - 1
        # a document's lines start at its first character and after each of its line feeds
        self.start = np.concatenate([bounds[:-1], feeds + 1])
        self.row = np.concatenate([np.arange(rows), row_of_feed])
        order = np.lexsort((self.start, self.row))
        self.start, self.row = self.start[order], self.row[order]
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        self.number = np.arange(len(self.start)) - self.first[self.row]
        self.end = np.empty_like(self.start)
        self.end[:-1] = self.start[1:] - 1
        last = self.first[1:] - 1
        self.end[last] = bounds[1:]
        self.size = self.end - self.start
        marks = np.concatenate([[0], np.cumsum(~_BLANK[np.minimum(self.chars, len(_BLANK) - 1)])])
        self.filled = marks[self.end] > marks[self.start]
        self.sums = bt.Sums(self.chars.astype(np.uint64))
        self.raw = self.sums.spans
        at = np.append(lead, len(data))
        self._bytes = data.tobytes(), at[self.start], at[self.end]
        self._digests: np.ndarray | None = None

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A cryptographic digest of whole lines, in two halves: equal lines are told by it alone."""
        if self._digests is None:
            data, start, end = self._bytes
            filled = np.flatnonzero(self.filled)
            spans = zip(start[filled].tolist(), end[filled].tolist(), strict=True)
            made = b"".join([blake2b(data[s:e], digest_size=16).digest() for s, e in spans])
            self._digests = np.zeros((len(self.start), 2), np.uint64)
            self._digests[filled] = np.frombuffer(made, np.uint64).reshape(-1, 2)
        return self._digests[which, 0], self._digests[which, 1]

    def firsts(self) -> np.ndarray:
        """The lines, not blank, that no earlier line of their document equals."""
        which = np.flatnonzero(self.filled)
        one, two = self.hashes(which)
        order = np.lexsort((which, two, one, self.row[which]))
        a, b, r = one[order], two[order], self.row[which][order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (r[1:] != r[:-1])
        return np.sort(which[order[new]])

    def blocks(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Lines without a block: line, key, the left-out block's start and end, and the blocks' unit.

        The blocks' unit follows the longer line of a pair, so a line that would get
        another unit if it were one longer emits keys for that too.
        """
        for longer in (0, 1):
            size = self.size[which] + longer
            fits = (size % BLOCK_CHARS == 0) & (size > 0) if longer else size >= BLOCK_CHARS
            chosen, units = which[fits], size[fits] // BLOCK_CHARS * 4
            s, e = self.start[chosen], self.end[chosen]
            for j in range(BLOCKS):
                head, tail = s + j * units, e - (BLOCKS - 1 - j) * units
                key = bt.mix(self.raw(s, head) * _K[1] + self.raw(tail, e) * _K[2] + units.astype(np.uint64) * _K[3] + np.uint64(j))
                yield chosen, key, head, tail, units

    def parts(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Lines without a part of a block: line, the block's key, finer key, and the part's start and end.

        The block of the shorter of two lines may lack one character of four parts; its
        parts then overlap there, and a left-out part may be empty.
        """
        for line, key, head, tail, units in self.blocks(which):
            unit = units // BLOCKS
            for i in range(BLOCKS):
                start, end = head + i * unit, tail - (BLOCKS - 1 - i) * unit
                rest = self.raw(head, start) * _K[1] + self.raw(end, tail) * _K[2]
                yield line, key, bt.mix(rest + key * _K[3] + np.uint64(i + BLOCKS)), start, end

    def variants(self, key: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For left-out blocks: entry, role and key of each variant.

        Role 0: without a character, by its place (an exchange).  Role 1: without one, by
        what is left (the longer line).  Role 2: whole (the shorter line).
        """
        size = tail - head
        entry = np.repeat(np.arange(len(key)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + head[entry]
        h, t = head[entry], tail[entry]
        less = bt.mix(self.sums.without(h, at, t) + (t - h - 1).astype(np.uint64) * _K[4] + key[entry])
        exchange = bt.mix(less + (at - h).astype(np.uint64) * _K[5])
        whole = bt.mix(self.raw(head, tail) + size.astype(np.uint64) * _K[4] + key)
        entries = np.concatenate([entry, entry, np.arange(len(key))])
        roles = np.repeat(np.array([0, 1, 2], np.int32), [len(entry), len(entry), len(key)])
        return entries, roles, np.concatenate([exchange, less, whole])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct lines: doc_id, line, h1, h2, n, keys (of the blocks left out), body (of short ones)."""
    for batch in batches:
        for chunk in bt.chunks(batch.column("text")):
            lines = Lines(chunk)
            which = lines.firsts()
            one, two = lines.hashes(which)
            parts = list(lines.blocks(which))
            line = np.concatenate([p[0] for p in parts])
            key = np.concatenate([p[1] for p in parts])
            order = np.argsort(line, kind="stable")
            offsets = np.searchsorted(line[order], np.append(which, which[-1] + 1 if len(which) else 0))
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key[order].view(np.int64)))
            spans = zip(lines.start[which].tolist(), lines.end[which].tolist(), strict=True)
            bodies = [lines.text[s:e] if e - s < BLOCK_CHARS else None for s, e in spans]
            ids = batch.column("doc_id").take(pa.array(chunk.first + lines.row[which]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lines.number[which], pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(lines.size[which], pa.int32()), keys, pa.array(bodies, pa.string())], names=["doc_id", "line", "h1", "h2", "n", "keys", "body"])


def _asked(batch: pa.RecordBatch, chunk: bt.Chunk, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, key and roles of each entry of the rows' lists `wanted`."""
    wanted = batch.column("wanted").slice(chunk.first, chunk.rows)
    asked = wanted.flatten()
    row = np.repeat(np.arange(chunk.rows), np.asarray(wanted.value_lengths()))
    line = lines.first[row] + np.asarray(asked.field("line"))
    own = line < lines.first[row + 1]  # another row of the same doc_id may be meant
    return line[own], np.asarray(asked.field("key")).view(np.uint64)[own], np.asarray(asked.field("roles"))[own]


def _allowed(have: tuple[np.ndarray, np.ndarray], line: np.ndarray, keys: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """The roles that are wanted of each pair (line, key) at hand; 0: none."""
    pairs, want = np.rec.fromarrays(have), np.rec.fromarrays([line, keys])
    _, code = np.unique(np.concatenate([pairs, want]), return_inverse=True)
    allowed = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int32)
    np.bitwise_or.at(allowed, code[len(pairs) :], roles)
    return allowed[code[: len(pairs)]]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the lines and block keys that each row's list `wanted` names: key (finer), n, h1, doc_id, line."""
    for batch in batches:
        for chunk in bt.chunks(batch.column("text")):
            lines = Lines(chunk)
            asked = _asked(batch, chunk, lines)
            if not len(asked[0]):
                continue
            line, block, key = (np.concatenate(x) for x in list(zip(*lines.parts(np.unique(asked[0])), strict=True))[:3])
            hit = _allowed((line, block), *asked) > 0
            line, key = line[hit], key[hit]
            one, _ = lines.hashes(line)
            for i in range(0, len(key), 200_000):
                cut = slice(i, i + 200_000)
                ids = batch.column("doc_id").take(pa.array(chunk.first + lines.row[line[cut]]))
                yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(lines.size[line[cut]], pa.int32()), pa.array(one[cut].view(np.int64)), ids, pa.array(lines.number[line[cut]], pa.int32())], names=["key", "n", "h1", "doc_id", "line"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The variants of the lines and finer keys that each row's list `wanted` names."""
    for batch in batches:
        for chunk in bt.chunks(batch.column("text")):
            lines = Lines(chunk)
            asked = _asked(batch, chunk, lines)
            if not len(asked[0]):
                continue
            line, _, key, head, tail = (np.concatenate(x) for x in zip(*lines.parts(np.unique(asked[0])), strict=True))
            allowed = _allowed((line, key), *asked)
            hit = allowed > 0
            entry, role, variant = lines.variants(key[hit], head[hit], tail[hit])
            fits = allowed[hit][entry] >> role & 1 == 1
            entry, role, variant = entry[fits], role[fits], variant[fits]
            at = line[hit][entry]
            yield from _placed(variant, role, batch.column("doc_id"), chunk.first + lines.row[at], pa.array(lines.number, pa.int32()), at)


def _placed(key: np.ndarray, role: np.ndarray, ids: pa.Array, row: np.ndarray, numbers: pa.Array, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 200_000):
        cut = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(role[cut]), ids.take(pa.array(row[cut])), numbers.take(pa.array(at[cut]))], names=["key", "role", "doc_id", "line"])


def _whole_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The variants of whole short lines, one a row: doc_id, line, body."""
    for batch in batches:
        for chunk in bt.chunks(batch.column("body")):
            lines = Lines(chunk)
            entry, role, key = lines.variants(np.full(chunk.rows, _WHOLE), lines.start, lines.end)
            row = chunk.first + entry
            yield from _placed(key, role, batch.column("doc_id"), row, batch.column("line"), row)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines to go and without later equal lines of the same document.

    The first columns are the lines to go, doc_id and text; the others pass through.
    """
    for whole in batches:
        for first in range(0, len(whole), REBUILT_ROWS):
            batch = whole.slice(first, REBUILT_ROWS)
            gone, known = batch.column(0).to_pylist(), batch.column(1).is_valid().to_pylist()
            texts, total, removed = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines = (text or "").split("\n")
                if text is None or not known[i]:
                    texts.append(text), total.append(len(lines) if text else 0), removed.append(0)
                    continue
                out, drop, seen = [], set(gone[i] or ()), set()
                for number, line in enumerate(lines):
                    if len(line) >= MIN_CHARS and not line.isspace():
                        if line in seen:
                            continue
                        seen.add(line)
                        if number in drop:
                            continue
                    out.append(line)
                texts.append("\n".join(out)), total.append(len(lines) if text else 0), removed.append(len(lines) - len(out))
            columns = [pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["text", "lines", "removed", *batch.schema.names[3:]])
        bt.release()


def _wanted(rows: DataFrame) -> DataFrame:
    """doc_id and the list (line, key, roles) of the lines that share their key with a different line they may be one edit from.

    An exchange needs another line of the same length, an insertion one that differs by one.
    """
    sizes = rows.groupBy("key", "n").agg((F.min("h1") != F.max("h1")).alias("equal"))
    one_less, one_more = (sizes.select("key", (F.col("n") + d).alias("n"), F.lit(True).alias(name)) for d, name in ((1, "longer"), (-1, "shorter")))
    roles = sizes.join(one_less, ["key", "n"], "left").join(one_more, ["key", "n"], "left").fillna(False, ["longer", "shorter"])
    roles = roles.where("equal or longer or shorter").select("key", "n", (F.col("equal").cast("int") + 2 * F.col("longer").cast("int") + 4 * F.col("shorter").cast("int")).alias("roles"))
    return rows.join(roles, ["key", "n"]).groupBy("doc_id").agg(F.collect_set(F.struct("line", "key", "roles")).alias("wanted"))


def later_lines(spark: SparkSession, documents: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, line: the lines, each document's first of their kind, that have an earlier neighbour."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    lines = tables.write(texts.mapInArrow(_lines, "doc_id long, line int, h1 long, h2 long, n int, keys array<long>, body string"), "lines")
    same = ["h1", "h2"]
    firsts = lines.groupBy(*same).agg(F.min("doc_id").alias("lead"))
    marked = lines.join(firsts, same)
    equal = tables.write(marked.where("doc_id > lead").select("doc_id", "line"), "equal")
    # a short line's body stands in a row of its own, without a key
    every = F.explode(F.expr("if(body is null, keys, concat(keys, array(cast(null as long))))")).alias("key")
    distinct = marked.where("doc_id = lead").select("doc_id", "line", "h1", "n", every, "body")
    distinct = tables.write(distinct.withColumn("body", F.expr("if(key is null, body, null)")), "keys")
    keys = distinct.where("key is not null").drop("body")
    short = tables.write(distinct.where("key is null").select("doc_id", "line", "body"), "short")
    tables.drop("lines")
    shared = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    near = tables.write(keys.join(shared, "key"), "near")
    tables.drop("keys")
    wanted = tables.write(_wanted(near), "wanted")
    tables.drop("near")
    finer = narrowed(texts, wanted, "doc_id").join(wanted, "doc_id").mapInArrow(_parts, "key long, n int, h1 long, doc_id long, line int")
    finer = tables.write(finer, "finer")
    asked_of = tables.write(_wanted(finer), "parts")
    made = "key long, role int, doc_id long, line int"
    variants = narrowed(texts, asked_of, "doc_id").join(asked_of, "doc_id").mapInArrow(_variants, made)
    variants = tables.write(variants.unionAll(short.mapInArrow(_whole_variants, made)), "variants")
    for name in ("wanted", "finer", "parts", "short"):
        tables.drop(name)
    place = F.struct("doc_id", "line")
    least = variants.groupBy("key").agg(*(F.min(F.when(F.col("role") == r, place)).alias(f"m{r}") for r in range(3)), F.max(place).alias("most"))
    least = least.where("most > least(m0, m1, m2)").drop("most")
    earliest = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = variants.join(least, "key").select("doc_id", "line", earliest.alias("before")).where(F.col("before") < place)
    pairs = tables.write(pairs.groupBy("doc_id", "line").agg(F.min("before").alias("before")), "pairs")
    tables.drop("variants")
    flat = pairs.select("doc_id", "line", F.col("before.doc_id").alias("doc_b"), F.col("before.line").alias("line_b"))

    asked = flat.select("doc_id", "line").unionAll(flat.select(F.col("doc_b").alias("doc_id"), F.col("line_b").alias("line")))
    asked = tables.write(asked.groupBy("doc_id").agg(F.collect_set("line").alias("asked")), "asked")
    split = narrowed(texts, asked, "doc_id").join(asked, "doc_id").select("doc_id", "asked", F.split("text", "\n", -1).alias("all"))
    bodies = split.select("doc_id", F.explode("asked").alias("line"), "all").select("doc_id", "line", F.expr("get(all, line)").alias("body")).distinct()
    bodies = tables.write(bodies, "bodies")
    other = bodies.select(F.col("doc_id").alias("doc_b"), F.col("line").alias("line_b"), F.col("body").alias("body_b"))
    near = flat.join(bodies, ["doc_id", "line"]).join(other, ["doc_b", "line_b"]).where(F.levenshtein("body", "body_b", 1) >= 0).select("doc_id", "line")
    return equal.unionAll(near).distinct()


def dedup_lines(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents with shortened texts and two more columns, last: __lines and __removed.

    Every row stays, also one whose text becomes empty.  Rows with a null doc_id or text
    stay as they are; rows that share a doc_id are read as one document: the same line
    number of both is no repetition.  Of equal lines the one of the smallest doc_id and
    line number stays.  Texts and lines of any length are taken whole.  An empty table
    gives no rows.  Other columns pass through; if they have the names of the new ones,
    the new ones get underscores at their ends.
    """
    tables = Tables(spark)
    found = later_lines(spark, documents, tables)
    gone = tables.finish(found.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))).select(F.col("doc_id").alias("gone_id"), F.col("lines").alias("gone_lines"))
    # numbered names: Spark's own hand-over does not take every column name
    names = documents.columns
    plain = documents.select(*quoted(names)).toDF(*(f"c{i}" for i in range(len(names))))
    doc, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    rest = [c for c in plain.columns if c != text]
    # merged, not broadcast: lists of line numbers are far smaller in a file than in memory
    joined = plain.join(gone.hint("merge"), F.col(doc) == F.col("gone_id"), "left").select("gone_lines", F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), *rest)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.select(*rest).schema)
    out = joined.mapInArrow(_rebuild, f"text string, lines long, removed long, {fields}")
    return out.select(*("text" if c == text else c for c in plain.columns), "lines", "removed").toDF(*names, fresh(names, "__lines"), fresh(names, "__removed"))
