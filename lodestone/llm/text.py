"""Texts of Arrow batches as flat numpy byte arrays: pieces of bounded size, words, rolling hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Bytes of words that are hashed at once; a longer word is hashed by itself.
HASHED_BYTES = 1 << 22
#: True for bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p, factor = np.ones(1, np.uint64), b
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(factor)])
                factor = factor * factor % (1 << 64)
            made.append(p[:n])
        _powers = made[0], made[1]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64 over all others."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """P with P[i] the hash sum of the first i symbols; span_hash reads any span's hash from it."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    up, _ = powers(len(symbols) + 1)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal for equal contents wherever they stand."""
    _, down = powers(len(p))
    return mixed((p[stop] - p[start]) * down[start] + (stop - start).astype(np.uint64))


def window_hash(p: np.ndarray, k: int) -> np.ndarray:
    """span_hash of every span of k symbols."""
    n = len(p) - k
    if n < 1:
        return np.zeros(0, np.uint64)
    return mixed((p[k:] - p[:n]) * powers(len(p))[1][:n] + np.uint64(k))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hash of every word of data, in runs of bounded size."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASHED_BYTES, "right")))
        p = prefix_hash(data[starts[i] : ends[j - 1]])
        out[i:j] = span_hash(p, starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out


def give_back() -> None:
    """Returns freed memory to the system, so that workers that wait for their next task hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with at most limit bytes, or of one longer row."""
    data, at = flat(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of the first word (one entry more than rows)."""
    inside = ~BLANK[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[at] = False  # a word never goes on into the next row
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[at] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
