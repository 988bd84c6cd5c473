"""Words and hashes of whole texts, straight from Arrow's byte buffers.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. All of
these are single bytes in UTF-8, so words can be found without decoding; a word's
hash is a difference of running sums, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import cache

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 2 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    x = (x ^ (x >> U64(31)) ^ (x >> U64(62))) * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> U64(27)) ^ (x >> U64(54))) * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_RADIX = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = cache()


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the radix (or of its inverse) modulo 2**64."""
    key = "-" if inverse else "+"
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, CHUNK + 1), pow(_RADIX, -1, 1 << 64) if inverse else _RADIX, U64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of up to `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = CHUNK, column: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts (in `column`) have about `limit` bytes (or one row), so that no copy of a column is larger."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(sizes[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
        pa.default_memory_pool().release_unused()


class Words:
    """The words of a chunk: byte positions `start` to `end`, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: int | None = None):
        """breaks: a byte (such as \\n) by which texts are split further; `counts` is then by piece."""
        self.data, n = data, len(data)
        if breaks is not None:
            cut = np.flatnonzero(data == breaks) + 1
            self.pieces = np.searchsorted(cut, offsets[1:-1], "right")
            merged = np.concatenate([offsets[:-1], cut])
            merged.sort(kind="stable")
            #: How many pieces each text has: one more than its breaks.
            self.per_text = np.diff(np.searchsorted(cut, offsets, "right")) + 1
            # a break that ends a text opens one more (empty) piece, at the next text's start
            offsets = np.concatenate([merged, offsets[-1:]])
        self.offsets = offsets
        inside = ~SEPARATOR[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < n]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = offsets[1:][offsets[1:] > 0] - 1
        last[at] = inside[at]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * powers(n), out=sums[1:])
    return mix64((sums[end] - sums[start]) * powers(n + 1, True)[start] + (end - start).astype(U64))


def sequence_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums from which sequence_hashes takes the hash of any run of words."""
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(len(hashes)), out=sums[1:])
    return sums


def sequence_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words start to end, the same wherever they stand."""
    return mix64((sums[end] - sums[start]) * powers(len(sums), True)[start] + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))


def count_unique(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sum of each weight by key (of ones, if there is none)."""
    if not weights:
        return np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, *weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], *(np.add.reduceat(w[order], at) for w in weights)
