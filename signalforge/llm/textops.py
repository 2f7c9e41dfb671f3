"""Words and shingles of whole batches of texts as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text worked on together; a longer text is worked on alone.
CHUNK = 1 << 18
_ZSTD = pa.Codec("zstd", compression_level=1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def release() -> None:
    """Give memory that a finished task has freed back to the machine: workers wait idle beside others for their next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only in the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def packed(values: np.ndarray, kind: type) -> bytes:
    """Numbers as planes of their bytes: those that are alike compress to little."""
    return np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def squeezed(values: np.ndarray, kind: type) -> bytes:
    """packed() and compressed: most df are 1."""
    data = packed(values, kind)
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    return unpacked(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), kind)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, text = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(text, np.uint8) if text is not None and len(text) else np.zeros(0, np.uint8)
    return data, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, tails: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of each word, words of each text); ASCII letters count as lower case. tails: then the last two bytes of each word too."""
    low = _LOWER[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    n = len(low)
    if not n:
        none = np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
        return (*none, np.zeros(0, np.uint16)) if tails else none
    black = ~_WHITE[low]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins, ends = black.copy(), black.copy()
    begins[1:] &= ~black[:-1] | edge[1:n]
    ends[:-1] &= ~black[1:] | edge[1:n]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _power_tables(n)
    sums = np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n])
    before = np.where(begins > 0, sums[begins - 1], np.uint64(0))
    hashes = mix((sums[ends] - before) * down[begins])
    counts = np.diff(np.searchsorted(begins, at))
    if not tails:
        return hashes, counts
    last = low[ends].astype(np.uint16)
    return hashes, counts, last | np.where(ends > begins, low[ends - 1].astype(np.uint16) << 8, 0).astype(np.uint16)


def chunks(column: pa.Array, tails: bool = False) -> Iterator[tuple]:
    """(first row, last row + 1, word hashes, words a row, and tails if asked for) for runs of rows of about CHUNK bytes."""
    data, offsets = utf8(column)
    low, n = 0, len(column)
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        yield low, high, *word_hashes(data, offsets[low : high + 1], tails)
        low = high


def shingles(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, shingles a row); fewer than `width` words make one shingle, no words none."""
    if not len(words):
        return words, counts
    odd = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    full = np.maximum(counts - width + 1, 0)
    ends = np.cumsum(counts)
    starts = ends - counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    number = full.copy()
    number[short] = 1
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        shifted = words[k:] * odd[k]
        total[: len(shifted)] += shifted
    offsets = np.cumsum(number) - number
    first = np.repeat(starts, number)
    place = np.arange(int(number.sum())) - np.repeat(offsets, number)
    out = total[first + place]
    for row in short.tolist():
        own = words[starts[row] : ends[row]]
        out[offsets[row]] = (own * odd[: len(own)]).sum() + np.uint64(len(own))
    return mix(out), number


def distinct(values: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different values of each row in ascending order, how often each occurs, different values a row)."""
    row = np.repeat(np.arange(len(number)), number)
    if len(values) > 16 * len(number):  # rows sorted one by one take less time than an order of all of them
        values = values.copy()
        ends = np.cumsum(number)
        for low, high in zip((ends - number).tolist(), ends.tolist(), strict=True):
            values[low:high].sort()
    else:
        order = np.lexsort((values, row))
        values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values))), np.bincount(row[at], minlength=len(number))
