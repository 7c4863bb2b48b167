"""Texts of an Arrow batch as numpy arrays: words, lines, n-grams and their hashes, without Python string objects.

A batch is cut into chunks of half a megabyte of whole texts, so that memory follows the longest text, not the batch.
Words are runs of anything but the six ASCII white-space characters; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (splitmix finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, CHUNK_BYTES + 1), _BASE if kind == "up" else _UNBASE, dtype=np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if n <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have


@dataclass
class Chunk:
    """Rows ``lo:hi`` of a batch: their bytes, and where each row begins (one entry more than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the words."""
        return runs(~SPACE[self.data], self.offsets)

    def row_of(self, starts: np.ndarray) -> np.ndarray:
        """Row of each position of a non-empty range."""
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range, the same wherever the bytes stand."""
        n = len(self.data)
        if n == 0:
            return mix(np.zeros(len(starts), dtype=np.uint64))
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", n)[:n], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * _power("down", n + 1)[starts])

    def counts(self, positions: np.ndarray) -> np.ndarray:
        """How many of the ascending positions lie in each row."""
        at = np.searchsorted(positions, self.offsets)
        return np.diff(at)

    def sums(self, positions: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sum of the values at ascending positions, by row."""
        at = np.searchsorted(positions, self.offsets)
        total = np.zeros((len(values) + 1, *values.shape[1:]))
        np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    def ngrams(self, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-byte grams that lie within a row, and where they begin."""
        size = len(self.data) - n + 1
        if size <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        h = np.full(size, seed, dtype=np.uint64)
        wide = self.data.astype(np.uint64)
        for j in range(n):
            h *= np.uint64(0x100000001B3)
            h += wide[j : j + size]
        inside = np.ones(size, dtype=bool)
        for j in range(1, n):
            cut = self.offsets - j
            inside[cut[(cut >= 0) & (cut < size)]] = False
        at = np.flatnonzero(inside)
        return h[at] * np.uint64(0x9E3779B97F4A7C15), at


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of true entries; a range never crosses a row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def text_column(batch: pa.RecordBatch, name: str = "text", lower: bool = False) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large string or binary array."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole rows, ``limit`` bytes or a single row at a time."""
    data, offsets = raw(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        own = offsets[lo : hi + 1]
        yield Chunk(lo, hi, data[own[0] : own[-1]], own - own[0])
        lo = hi


def whole(column: pa.Array) -> Chunk:
    """All rows as one chunk, for columns known to be small."""
    data, offsets = raw(column)
    return Chunk(0, len(column), data, offsets)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, and each row's number of them.

    ``hashes`` are the words of all rows, ``counts`` the words of each row. A row of fewer than ``k`` words, but with
    one at least, has a single shingle of all its words; a row without words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(hashes)
    own = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if n == 0:
        return np.zeros(0, dtype=np.uint64), own
    out = np.zeros(n, dtype=np.uint64)
    left = np.repeat(ends, counts) - np.arange(n)
    for j in range(k):
        out *= np.uint64(0x2545F4914F6CDD1D)
        add = np.zeros(n, dtype=np.uint64)
        add[: n - j] = hashes[j:]
        add[left <= j] = 0
        out += add
    keep = left >= k
    short = starts[(counts > 0) & (counts < k)]
    keep[short] = True
    return mix(out[keep]), own



def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
