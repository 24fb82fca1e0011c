"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokens are found without a regular expression.  Every code point becomes one of a
few symbols (its class, and for blanks and apostrophes what follows), every symbol is
a function from automaton state to automaton state, and functions compose.  The closed
set of all compositions is small, so a composition table turns the left-to-right scan
into an associative one: blocks of a text buffer are scanned side by side, one table
look-up a code point, and joined by their blocks' products.

The slices between boundaries go through a merge cache; the words that it misses are
merged together, all words of a chunk at a time, by rank.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import bytetext as bt
from loomnote.llm.shared import small_batches

CACHE_WORDS = 150_000
LONG_WORD = 512

# States: which token is open after a code point.
LETTERS, NUMBERS, OTHERS, CLOSED, BLANK, SPACES, LAST, LAST_BUT_ONE = range(8)
# Symbols.  BODY: white space before white space or the end.  LEAD: a blank before other
# text.  EDGE: other white space before other text.  SHORT and PAIR: an apostrophe before
# a contraction of one or two letters.  BREAK stands between documents.
S_LETTER, S_NUMBER, S_OTHER, S_BODY, S_LEAD, S_EDGE, S_SHORT, S_PAIR, S_BREAK = range(9)
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    run = {S_LETTER: LETTERS, S_NUMBER: NUMBERS, S_OTHER: OTHERS}
    if symbol == S_BREAK:
        return CLOSED, False
    if symbol == S_BODY:
        return SPACES, state != SPACES
    if symbol == S_LEAD:
        return BLANK, True
    if symbol == S_EDGE:
        return CLOSED, True
    if state == LAST_BUT_ONE:
        return LAST, False
    if state == LAST:
        return CLOSED, False
    if symbol in (S_SHORT, S_PAIR):
        if state in (OTHERS, BLANK):
            return OTHERS, False
        return (LAST if symbol == S_SHORT else LAST_BUT_ONE), True
    return run[symbol], state not in (run[symbol], BLANK)


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the symbols' functions, the composition table, and each function's values."""
    symbols = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    identity = tuple(range(8))
    known, order = {identity: 0}, [identity]
    for f in order:  # grows while it is read
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(order)
                order.append(h)
    table = np.array([[known[tuple(g[x] for x in f)] for g in order] for f in order])
    kind = np.uint8 if len(order) <= 256 else np.uint16
    return np.array([known[f] for f in symbols], kind), table.astype(kind), np.array(order, np.uint8)


STARTS = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])


@cache
def classes() -> np.ndarray:
    """Of each code point: 0 letter, 1 number, 2 other, 3 white space."""
    table = np.full(0x110000, 2, np.uint8)
    points = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for number, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, points):
            first, last = ord(m[0][0]), ord(m[0][-1])
            table[first : last + 1] = number
    table[0xD800:0xE000] = 2
    return table


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point; `ends` are the positions of the breaks after documents."""
    kind = classes()[points]
    out = kind.copy()
    n = len(points)
    stop = np.zeros(n, bool)
    stop[ends] = True
    out[stop] = S_BREAK
    after = np.full(n, 3, np.uint8)  # the end counts as white space
    after[:-1] = np.where(stop[1:], 3, kind[1:])
    space = (kind == 3) & ~stop
    out[space] = np.where(after[space] == 3, S_BODY, np.where(points[space] == 32, S_LEAD, S_EDGE))
    quote = np.flatnonzero((points == 39) & ~stop)
    if len(quote):
        padded = np.append(points, [0, 0]).astype(np.int64)
        halted = np.append(stop, [True, True])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in ONE_LETTER]) & ~halted[quote + 1]
        pair = np.zeros(len(quote), bool)
        for a, b in TWO_LETTERS:
            pair |= (one == ord(a)) & (two == ord(b))
        pair &= ~halted[quote + 1] & ~halted[quote + 2]
        out[quote[short]] = S_SHORT
        out[quote[pair]] = S_PAIR
    return out


def boundaries(symbol: np.ndarray, block: int = 512) -> np.ndarray:
    """True where a pre-token starts, by the blocked associative scan."""
    n = len(symbol)
    own, table, values = monoid()
    rows = -(-n // block) if n else 0
    padded = np.full(rows * block, S_BREAK, np.uint8)
    padded[:n] = symbol
    across = np.ascontiguousarray(own[padded].reshape(rows, block).T)
    flat, width = table.ravel(), table.shape[1]
    scanned = np.empty_like(across)  # function composed from the block's start, exclusive
    running = np.zeros(rows, table.dtype)
    for i in range(block):
        scanned[i] = running
        running = flat[running.astype(np.intp) * width + across[i]]
    entry = np.empty(rows, np.uint8)
    state = CLOSED
    for i, f in enumerate(running.tolist()):
        entry[i] = state
        state = int(values[f, state])
    before = values.ravel()[scanned.astype(np.intp) * 8 + entry].T.ravel()[:n]
    return STARTS.ravel()[before.astype(np.intp) * 9 + symbol]


def pre_tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start, and each document's first of them (and the end)."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.searchsorted(at, starts)
    ends = first[1:] + np.arange(len(first) - 1)
    wide = np.zeros(len(points) + len(ends), np.uint32)
    hole = np.zeros(len(wide), bool)
    hole[ends] = True
    wide[~hole] = points
    begin = boundaries(symbols(wide, ends))[~hole]
    where = at[begin]
    return where, np.searchsorted(where, starts)


class Codec:
    """Encodes pre-tokens by merge ranks; keeps a bounded cache of those met before."""

    def __init__(self, ranks: dict[bytes, int], cache_words: int = CACHE_WORDS):
        self.ranks = ranks
        self.cache_words = cache_words
        self.of_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.of_id[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.pairs = key[order]
        self.pair_rank = np.array(rank, np.int64)[order]
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[place] == key, self.pair_rank[place], np.iinfo(np.int64).max)

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Merge words of one byte length class together; in each round, each word's best pair."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        out: list[tuple[int, ...]] = [()] * len(words)
        i = 0
        while i < len(order):
            width = int(lengths[order[i]])
            if width > LONG_WORD:
                out[order[i]] = self.merge_long(words[order[i]])
                i += 1
                continue
            j = i + int(np.searchsorted(lengths[order[i:]], max(width, width * 5 // 4), "right"))
            j = min(j, i + max(1, 4_000_000 // width))
            group = order[i:j].tolist()
            for k, ids in zip(group, self._merge_group([words[k] for k in group]), strict=True):
                out[k] = ids
            i = j
        return out

    def _merge_group(self, words: list[bytes]) -> list[tuple[int, ...]]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        ids = np.full((len(words), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        none = np.iinfo(np.int64).max
        active = np.arange(len(words))
        while len(active) and width > 1:
            part = ids[active]
            rank = np.where(part[:, 1:] >= 0, self._rank(part[:, :-1], np.maximum(part[:, 1:], 0)), none)
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(active)), best]
            go = low < none
            active, best, low, part = active[go], best[go], low[go], part[go]
            if not len(active):
                break
            part[np.arange(len(active)), best] = low
            keep = np.arange(width) != best[:, None] + 1
            ids[active, : width - 1] = part[keep].reshape(len(active), width - 1)
            ids[active, width - 1] = -1
            size[active] -= 1
        return [tuple(row[:n]) for row, n in zip(ids.tolist(), size.tolist(), strict=True)]

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """One very long pre-token, by a heap of pairs over a linked list."""
        import heapq

        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self._rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        none = np.iinfo(np.int64).max
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(rank) if r < none]
        heapq.heapify(heap)
        alive = [True] * n

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self._one(ids[i], ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return tuple(x for x, ok in zip(ids, alive, strict=True) if ok)

    def _one(self, a: int, b: int) -> int | None:
        return self.ranks.get(self.of_id[a] + self.of_id[b])

    def encode_chunk(self, data: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, ...]]]:
        """Per document the ids of each of its pre-tokens."""
        where, row = pre_tokens(data, starts)
        whole = data.tobytes()
        edge = where.tolist()
        edge.append(len(whole))
        pieces = [whole[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        seen = self.seen
        missing = list({p for p in pieces if p not in seen})
        if missing:
            if len(seen) + len(missing) > self.cache_words:
                seen.clear()
                missing = list(set(pieces))
            seen.update(zip(missing, self.merge(missing), strict=True))
        found = list(map(seen.__getitem__, pieces))
        bounds = row.tolist()
        return [found[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.of_id.__getitem__, ids))


def read_ranks(spark: SparkSession, path: str) -> str:
    """Give a rank file to every executor; the name under which they find it."""
    small_batches(spark)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    """The codec of a rank file that was sent to the executors, one a Python worker."""
    with open(SparkFiles.get(name), "rb") as lines:
        return Codec({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def encode(spark: SparkSession, documents: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: doc_id, ids (array<int>), offsets (array<int>: byte where each token starts).

    Null texts count as empty; an empty text has no ids.  Rows that share a doc_id are
    encoded one by one; other columns are ignored.
    """
    name = read_ranks(spark, ranks_path)

    def run(batches):
        own = codec(name)
        for batch in batches:
            for chunk in bt.chunks(batch.column("text")):
                ids = [list(chain.from_iterable(doc)) for doc in own.encode_chunk(chunk.data, chunk.starts)]
                at = [np.cumsum([0, *(len(own.of_id[i]) for i in doc[:-1])]).tolist() if doc else [] for doc in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, chunk.rows), pa.array(ids, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "ids", "offsets"])

    return _texts(documents).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode(spark: SparkSession, encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: doc_id and the bytes of its ids (null ids: no bytes)."""
    name = read_ranks(spark, ranks_path)

    def run(batches):
        own = codec(name)
        for batch in batches:
            data = [own.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(spark: SparkSession, documents: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    Encodes every whole text and decodes the ids again in the same task, so the ids,
    several times the text's size, never leave it.  Null texts count as empty; an empty text
    has no ids and the digests of nothing.  Rows that share a doc_id, or have none, are
    encoded one by one, so repeated rows give equal results; a very long text is one chunk
    of its own.  Other columns are ignored; an empty table gives no rows.
    """
    name = read_ranks(spark, ranks_path)

    def run(batches):
        own = codec(name)
        for batch in batches:
            for chunk in bt.chunks(batch.column("text")):
                counts, ids_sha, text_sha = [], [], []
                for doc in own.encode_chunk(chunk.data, chunk.starts):
                    ids = list(chain.from_iterable(doc))
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, chunk.rows), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(np.diff(chunk.starts))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                )

    return _texts(documents).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
