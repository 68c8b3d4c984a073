"""Byte-level text kernels shared by the operators: words, hashes and windows of whole Arrow batches in numpy.

Every kernel works on the UTF-8 bytes of many documents at once. ASCII rules (lower-casing A-Z, ASCII white
space, ASCII punctuation) act alike on bytes and on code points, since all bytes of a longer sequence are >= 0x80.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel holds at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words of any characters but ASCII white space.
NOT_SPACE = ~np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
#: Words of digits, lower-case letters and non-ASCII characters, after lower-casing.
ALNUM = np.isin(LOWER, [*range(48, 58), *range(97, 123)]) | (_BYTES >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _odd_powers(base: int, inverse: bool):
    """A growing table of base**i (or its inverse) modulo 2**64."""
    step = pow(base, -1, 1 << 64) if inverse else base
    table = np.ones(1, dtype=np.uint64)

    def upto(n: int) -> np.ndarray:
        nonlocal table
        while len(table) < n:
            table = np.concatenate([table, table * np.uint64(pow(step, len(table), 1 << 64))])
        return table[:n]

    return upto


_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_byte_powers, _byte_inverse = _odd_powers(_BASE, False), _odd_powers(_BASE, True)
_word_powers, _word_inverse = _odd_powers(_WORD_BASE, False), _odd_powers(_WORD_BASE, True)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LETTER_LOWER = _LETTER[LOWER]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; a null counts as an empty text."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a chunk of documents.

    data: the chunk's bytes; starts, ends: byte positions of each word in them; first[d]:first[d + 1] are the words
    of document d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.data = data = data[lo:hi]
        self.bounds = bounds = offsets - lo
        inside = kind[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[0], edge[-1] = True, True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[bounds] = True
        at = np.flatnonzero(edge)
        left, right = at[:-1], at[1:]
        keep = inside[left] if len(data) else np.zeros(0, bool)
        self.starts, self.ends = left[keep], right[keep]
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes, lower-cased first if asked."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LETTER_LOWER if lower else _LETTER)[self.data] * _byte_powers(n), out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * _byte_inverse(n)[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of so many consecutive word hashes (also of runs across documents)."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    if size == 1:
        return mix(words + np.uint64(1))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _word_powers(n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _word_inverse(n)[: n - size + 1] + np.uint64(size))


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n places lie in a run of the given size from one of the starts."""
    if len(starts) == 0:
        return np.zeros(n, bool)
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, n), -1)
    return np.cumsum(marks[:-1]) > 0


def rows(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts, each of a bounded number of bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        for i, j in chunks(offsets, most):
            yield batch.slice(i, j - i), data, offsets[i : j + 1]
    released()


def released() -> None:
    """Give what a task has freed back to the system: a worker stays for the next task, and its memory counts beside the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)
