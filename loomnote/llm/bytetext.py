"""Word arithmetic on the UTF-8 bytes of whole Arrow string columns.

Arrow keeps a string column as one byte buffer and one offset array.  The helpers
here find words and hash word runs for many documents at once, on that buffer, in
chunks of bounded size, so memory does not follow the length of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

#: ASCII A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for every byte outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for first, last in excluded:
        table[first : last + 1] = False
    return table


#: Words are runs without blank, tab, line feed, VT, FF and CR.
NON_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of digits, lower-case letters and non-ASCII bytes (after LOWER).
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


@dataclass
class Chunk:
    """Some consecutive documents: their first row, bytes, and row starts in the bytes."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.starts) - 1


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column (null: empty) into runs of rows of at most `limit` bytes or one row."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for part in parts:
        part = pc.fill_null(part, "")
        wide = pa.types.is_large_string(part.type)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64 if wide else np.int32)
        offsets = offsets[part.offset : part.offset + len(part) + 1].astype(np.int64)
        buffer = part.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            yield Chunk(base + i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j
        base += len(part)
    release()


_libc: list = []


def release() -> None:
    """Give memory that a batch no longer needs back to the system.

    Python workers live on between tasks, and allocators keep what they once had; in an
    executor of a few GB that is what other tasks lack.
    """
    pa.default_memory_pool().release_unused()
    if not _libc:
        import ctypes

        try:
            _libc.append(ctypes.CDLL(None).malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda pad: 0)
    _libc[0](0)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], dtype=np.uint64))[0])


#: Random numbers for a byte at each of 64 places of a span.
_PLACES = 64
_AT_PLACE = mix(np.arange(256 * _PLACES, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))

#: Sums over spans are polynomials modulo a prime, at two bases.  Modulo 2 ** 64 whole
#: families of texts (Thue and Morse's) would have equal sums whatever the base.
_MODULUS = np.uint64((1 << 31) - 1)
_BASES = (1_234_567_891, 987_654_323)
_LANES = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime, kept for chunks of the usual size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size, step = max(n, CHUNK_BYTES + 2), base
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(step) % _MODULUS])
            step = step * step % int(_MODULUS)
        if size == CHUNK_BYTES + 2:
            _powers[base] = have
    return have[:n]


class Sums:
    """Running sums over a sequence of numbers, for keys of any of its spans."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.lanes = []
        for base, seed in zip(_BASES, _LANES, strict=True):
            sums = np.zeros(n + 1, np.uint64)
            term = (mix(values ^ seed) >> np.uint64(33)) * _power(base, n)
            np.cumsum((term & _MODULUS) + (term >> np.uint64(31)), out=sums[1:])
            self.lanes.append((sums, _power(pow(base, -1, int(_MODULUS)), n + 2)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62 bits for each span, the same wherever in the sequence it stands."""
        low, high = ((s[end] - s[start]) % _MODULUS * inverse[start] % _MODULUS for s, inverse in self.lanes)
        return low | high << np.uint64(31)

    def without(self, start: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for each span when the number at one place in it is left out."""
        low, high = (((s[at] - s[start]) % _MODULUS * inverse[start] + (s[end] - s[at + 1]) % _MODULUS * inverse[start + 1]) % _MODULUS for s, inverse in self.lanes)
        return low | high << np.uint64(31)


@dataclass
class Words:
    """Spans of the words of a chunk; `row` holds each document's first word, and the end."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.row)

    def left(self) -> np.ndarray:
        """Words from each word to its document's end, itself included."""
        n = len(self.start)
        return np.repeat(self.row[1:], self.per_row) - np.arange(n)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), self.per_row)


def words(chunk: Chunk, table: np.ndarray, data: np.ndarray | None = None) -> Words:
    """The runs of bytes that `table` admits; none crosses from one document to the next."""
    data = chunk.data if data is None else data
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(chunk.starts), np.int64))
    inside = table[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    first = chunk.starts[:-1]
    first = first[first < n]
    opens[first] |= inside[first]
    last = chunk.starts[1:] - 1
    last = last[last >= 0]
    closes[last] |= inside[last]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, chunk.starts))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: a sum of random numbers, one for each byte and its place."""
    size = end - start
    filled = size > 0
    first, size = start[filled], size[filled]
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    code = data[place + np.repeat(first, size)].astype(np.intp) * _PLACES
    value = _AT_PLACE[code + (place & _PLACES - 1)]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        value[far] = mix(value[far] + (place[far] // _PLACES).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    out = np.zeros(len(start), np.uint64)
    if len(before):
        out[filled] = np.add.reduceat(value, before)
    return mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(mix_int(seed + 1)))


def run_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` neighbouring word hashes (shorter by length - 1)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for i in range(length):
        factor = factor * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1 | 1
        total += hashes[i : i + n] * np.uint64(factor)
    return mix(total)
