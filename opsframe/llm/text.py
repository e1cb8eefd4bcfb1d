"""Vectorised work on Arrow text columns: blocks of bytes, words, hashes of spans, and winnowed windows.

Texts are handled as UTF-8 bytes. A block holds whole documents of about two megabytes, or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_POSITION_BITS = 28

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
LETTERS = np.zeros(256, bool)  # digits, ASCII letters and everything beyond ASCII
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    if len(_powers.get(kind, ())) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        steps = np.full(max(n, BLOCK_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Hashes:
    """Hashes of spans of a sequence of 64-bit values: equal spans have equal hashes, at any place and in any block."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power("up", len(values)), out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _power("down", len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k values from each position on."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:k + n] - self.sums[:n]) * _power("down", len(self.sums))[:n] + U64(k))


def of_bytes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    return (_BYTES[LOWER] if lower else _BYTES)[data]


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for consecutive rows of a batch."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    data, offsets = parts(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield (batch.slice(first, last - first), data[offsets[first]:offsets[last]],
               offsets[first:last + 1] - offsets[first])
        first = last


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each document the number of words before it."""
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = mask.copy(), mask.copy()
    starts[1:] &= edge[1:-1] | ~mask[:-1]
    ends[:-1] &= edge[1:-1] | ~mask[1:]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def documents_of(first: np.ndarray, n: int) -> np.ndarray:
    """The document of each of n units."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def winnow(grams: np.ndarray, first: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of `length` units that select the same k-gram: (first window, number of windows, k-gram).

    Each window selects its least k-gram hash, the leftmost of equals, so the choice depends on its content alone:
    equal windows select equal k-grams at the same distance from their start. Windows lie within one document.
    """
    none = np.zeros(0, np.int64)
    n = first[-1] - length + 1
    if n <= 0:
        return none, none, none
    if len(grams) >> _POSITION_BITS:
        raise ValueError("a document has more than 2**28 units")
    low = U64(_POSITION_BITS)
    least = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    across, width = length - k + 1, 1
    while 2 * width <= across:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < across:
        least = np.minimum(least[:len(least) - (across - width)], least[across - width:])
    chosen = (least[:n] & U64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    change = np.zeros(n + 1, np.int64)
    long = np.diff(first) >= length
    np.add.at(change, first[:-1][long], 1)
    np.add.at(change, first[1:][long] - length + 1, -1)
    valid = np.cumsum(change)[:n] > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (chosen[1:] != chosen[:-1])
    starts = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    return starts, np.flatnonzero(ends) + 1 - starts, chosen[starts]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def lists(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values) if isinstance(values, np.ndarray) else values)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
