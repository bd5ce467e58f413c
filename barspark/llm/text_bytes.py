"""Texts as bytes in numpy: whole Arrow columns are cut and hashed at once, without a dictionary of words."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a part of its own and is hashed block by block.
PART, BLOCK = 1 << 19, 1 << 18
#: ASCII white space, as ``bytes.split()`` has it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random odd number for each byte, for each but white space, and for each without regard to ASCII case.
BYTES = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORDS = np.where(SPACE, np.uint64(0), BYTES)
LOWER_WORDS = WORDS.copy()
LOWER_WORDS[65:91] = WORDS[97:123]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: np.ndarray) -> np.ndarray:
    return mixed((n.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_PLACES = _multipliers(np.arange(1 << 12))


def frees(run: Callable) -> Callable:
    """A function of batches that gives its task's memory back at the end: workers outlive their tasks."""

    @functools.wraps(run)
    def freed(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return freed


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column and where each begins (one more: the end); null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    c = column.cast(pa.large_binary())
    ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] else np.empty(0, np.uint8)
    return data, ends


def parts(ends: np.ndarray, most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes each, and one row at least."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hash_spans(x: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64 bits for each span of bytes from one start to the next: the mixed sum of ``table[byte]`` times a multiplier of its place."""
    out = np.zeros(len(starts), np.uint64)
    p, n = int(starts[0]) if len(starts) else len(x), len(x)
    while p < n:
        q = min(p + BLOCK, n)
        a, b = int(np.searchsorted(starts, p, "right")) - 1, int(np.searchsorted(starts, q, "left"))
        edges = np.maximum(starts[a:b], p) - p
        place = np.arange(p, q) - np.repeat(starts[a:b], np.diff(edges, append=q - p))
        v = table[x[p:q]] * (_PLACES[place] if place.max() < len(_PLACES) else _multipliers(place))
        out[a:b] += np.add.reduceat(v, edges)
        p = q
    return mixed(out)


def word_starts(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the words of the texts begin; ``at``: where the texts do, and the end."""
    inside = ~SPACE[x]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(x)]
    first[edges] = inside[edges]
    return np.flatnonzero(first)


def word_hashes(x: np.ndarray, ends: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts ``x[ends[i]:ends[i + 1]]``, and where each text's words begin among them (one more: the end)."""
    base = int(ends[0])
    x, at = x[base : int(ends[-1])], ends - base
    starts = word_starts(x, at)
    return hash_spans(x, starts, table), np.searchsorted(starts, at, "left")
