"""Vectorised text kernels shared by the free-style operators of this subpackage.

Everything here works on one Arrow batch inside one task.  Texts are cut into
slices of at most ``SLICE_BYTES`` at white space, so the temporary arrays stay
small however long a text is.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 18
#: Bytes of text of which the results are kept together.
GROUP_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PRIME = np.uint64(0x100000001B3)
_SHIFTS = (np.uint64(30), np.uint64(27), np.uint64(31))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tidy(make):
    """For functions over Arrow batches: give memory back when a task ends, as workers live on."""

    @functools.wraps(make)
    def batches(*args):
        try:
            yield from make(*args)
        finally:
            release()

    return batches


def release() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _SHIFTS[0])) * _MIX[0]
        x = (x ^ (x >> _SHIFTS[1])) * _MIX[1]
    return x ^ (x >> _SHIFTS[2])


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _PRIME, np.uint64))), dtype=np.uint64)
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inverse, np.uint64))), dtype=np.uint64)
    return up, down


_UP, _DOWN = _power_tables(SLICE_BYTES)
#: By byte; of A-Z, those of a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)[_LOWER]


def spaces(data: np.ndarray) -> np.ndarray:
    """_SPACE[data], without a lookup for each byte."""
    return (data == 0x20) | (data - np.uint8(0x09) < 5)


def _slice_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one slice (at most SLICE_BYTES bytes)."""
    space = np.concatenate(([True], spaces(data), [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])  # where words start and stop, by turns
    if not len(edge):
        return np.empty(0, np.uint64)
    start, stop = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        own = total[1:]
        np.take(_BYTE, data, out=own, mode="clip")  # all are inside; "raise" makes a copy
        own *= _UP[: len(data)]
        np.cumsum(own, out=own)
        at = total[edge]
        value = (at[1::2] - at[::2]) * _DOWN[start]
        return mix(value + (stop - start).astype(np.uint64) * _GOLDEN)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words of UTF-8 bytes, in order.

    A word is a maximal run without [\\x20\\x09-\\x0D]; only A-Z are lower-cased.
    A word longer than a slice is hashed whole by folding its slices.
    """
    if len(data) <= SLICE_BYTES:
        return _slice_words(data)
    out, at = [], 0
    while at < len(data):
        stop = min(at + SLICE_BYTES, len(data))
        if stop < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:stop]])
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
            else:  # one word fills the slice: fold all of its slices
                value = np.uint64(0)
                while True:
                    stop = min(at + SLICE_BYTES, len(data))
                    spaces = np.flatnonzero(_SPACE[data[at:stop]])
                    end = at + int(spaces[0]) if len(spaces) else stop
                    if end > at:
                        value = mix((value ^ _slice_words(data[at:end])) * _PRIME)[0]
                    at = end
                    if len(spaces) or at >= len(data):
                        break
                out.append(np.array([value], np.uint64))
                continue
        out.append(_slice_words(data[at:stop]))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, the run of all of them."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    with np.errstate(over="ignore"):
        value = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            value = mix(value * _PRIME + words[k : n - width + 1 + k])
        return mix(value ^ np.uint64(width))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(words, size))


def utf8_views(column) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value of an Arrow string column (null: empty)."""
    import pyarrow as pa

    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        wide = pa.types.is_large_string(chunk.type)
        _, offsets, data = chunk.buffers()
        if not len(chunk):
            continue
        ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        valid = np.asarray(chunk.is_valid()) if chunk.null_count else None
        for i in range(len(chunk)):
            yield raw[ends[i] : ends[i + 1]] if valid is None or valid[i] else raw[:0]
