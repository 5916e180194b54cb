"""Word tables over Arrow string columns, computed on UTF-8 bytes with NumPy.

A word is a maximal run of bytes that a 256-entry table keeps; the table also folds letters. Words and
lines get 64-bit hashes of all their bytes, eight at a time for all words together, so no Python object is
made for a word (but for those of over ``LONG`` bytes). Work is done in chunks of about ``CHUNK`` bytes, whole documents each, which bounds
memory whatever the Arrow batch or the partition holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first 0 to 8 bytes of a little-endian long.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Multipliers of the words of a window.
SLOTS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def release() -> None:
    """Give freed memory back to the system: a worker process lives on, beside others, after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that releases memory when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def keep_table(keep: np.ndarray, fold: bool) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte itself (A-Z lower-cased if ``fold``)."""
    table = np.arange(256, dtype=np.uint8)
    if fold:
        table[65:91] += 32
    return np.where(keep[table], table, 0).astype(np.uint8)


def spaces_table(fold: bool) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+``; byte 0 is part of a word and gets the space's code."""
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    table = keep_table(keep, fold)
    table[0] = 0x20
    return table


def lines_table() -> np.ndarray:
    """Non-empty lines; byte 0 gets the line feed's code."""
    table = np.arange(256, dtype=np.uint8)
    table[0], table[0x0A] = 0x0A, 0
    return table


def alnum_table() -> np.ndarray:
    """Words of digits, letters and all bytes of non-ASCII characters, A-Z lower-cased."""
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x61:0x7B] = True
    keep[0x80:] = True
    return keep_table(keep, fold=True)


def chunks(values: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of whole rows of ``values`` (null: empty), of about ``limit`` bytes."""
    if values.null_count:
        values = pc.fill_null(values, b"" if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else "")
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(values) + 1, values.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@dataclass
class Words:
    """Words of consecutive documents: byte ranges, word hashes, and each document's first word."""

    kept: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """64 bits of each word: its length, then its bytes in blocks of eight, each mixed in turn."""
        size = self.end - self.start
        padded = np.zeros(len(self.kept) + 8, np.uint8)
        padded[: len(self.kept)] = self.kept
        blocks = np.ndarray(len(self.kept) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        h = mix(size.astype(np.uint64) * _STEP)
        which = np.flatnonzero(size <= LONG)
        at = 0
        while len(which):
            left = size[which] - at
            h[which] = mix(h[which] * _STEP ^ blocks[self.start[which] + at] & _FIRST[np.minimum(left, 8)])
            which, at = which[left > 8], at + 8
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(padded[self.start[i] : self.end[i]].data)
        return h


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Find the words of the documents that ``offsets`` cut from ``data``."""
    n = len(data)
    kept = table[data]
    inside = kept != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(kept, start, end, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries (callers mask runs that cross documents)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += hashes[i : i + n] * SLOTS[i]
    return mix(out)
