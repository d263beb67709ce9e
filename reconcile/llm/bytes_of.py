"""Texts as byte arrays: helpers that run inside Arrow tasks, bounded by slices of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

# Bytes of text that one slice holds; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_LETTER = mixed(np.arange(256, dtype=np.uint64))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of text each."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
    give_back()


# The C library's call to return unused memory to the system, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return memory that this worker holds but does not use, as other tasks of its machine may need it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    raw = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[raw[0] : raw[-1]], raw - raw[0]


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes within a text, and the first run of each text."""
    n = len(is_word)
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    ends = offsets[1:][offsets[1:] > 0]
    after[ends - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    stops = np.flatnonzero(is_word & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            step = pow(_BASE, len(cls.up), 1 << 64), pow(_INVERSE, len(cls.up), 1 << 64)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(step[0])])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(step[1])])
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the same bytes hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[:-1], out=total[1:])
    return mixed((total[stops] - total[starts]) * down[starts])


def space_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and each text's first."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    is_word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts, stops, first = word_bounds(is_word, offsets)
    return word_hashes(data, starts, stops), first


def group_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


_made: dict[str, Any] = {}


def made_once(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, kept by this worker until something of another key is asked for."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]
