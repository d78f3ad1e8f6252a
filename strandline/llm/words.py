"""Vectorised word tables over Arrow string columns.

A text column of an Arrow batch already is one byte buffer with offsets, so words, word hashes and
n-gram hashes of thousands of documents come from a few numpy passes, without Python objects.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a single longer text makes a chunk of its own.
CHUNK_BYTES = 4 << 20
_HASH_BLOCK = 1 << 20

#: `[^\x20\x09-\x0D]+`
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[48:58] = NON_ALNUM[97:123] = NON_ALNUM[128:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(7919)
_BYTE = _random.integers(1 << 20, 1 << 63, size=(2, 256), dtype=np.uint64)
_BASE = (_random.integers(1 << 40, 1 << 63, size=2, dtype=np.uint64) << np.uint64(3)) | np.uint64(5)
_GRAM = _random.integers(1 << 40, 1 << 63, size=2, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the public murmur3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX[0]
    h ^= h >> np.uint64(33)
    h *= _MIX[1]
    h ^= h >> np.uint64(33)
    return h


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], at - at[0]


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library keeps its memory
        return lambda pad: 0


def release() -> None:
    """Gives freed memory back to the system: workers live on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    _, at = buffer_of(batch.column(text))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        release()
        row = end


def word_table(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for n texts the n + 1 positions where their words begin."""
    inside = ~separator[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begin[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    end[tails] = inside[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


@lru_cache(4)
def _powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASE[lane])
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; two lanes are independent of each other."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        origin = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, origin + _HASH_BLOCK, "right")))
        size = int(ends[j - 1] - origin)
        up, down = _powers(lane, max(_HASH_BLOCK, 1 << (size - 1).bit_length()))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[lane][data[origin : origin + size]] * up[:size], out=total[1:])
        s, e = starts[i:j] - origin, ends[i:j] - origin
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """A hash of each run of n words, wherever it starts (runs over a text's end included)."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = out * _GRAM[lane] + words[k : k + count]
    return mix(out)


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a run of n words of one text starts, and their texts."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][owner], owner


def shingles(data: np.ndarray, at: np.ndarray, n: int, separator: np.ndarray = SPACE, lanes: int = 1):
    """Per text its n-word shingle hashes; a text of fewer words, but not none, has one of all of them."""
    starts, ends, first = word_table(data, at, separator)
    where, owner = gram_starts(first, n)
    lengths = np.diff(first)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    result = []
    for lane in range(lanes):
        hashed = word_hashes(data, starts, ends, lane)
        grams = gram_hashes(hashed, n, lane)[where]
        own = np.array([gram_hashes(hashed[first[i] : first[i + 1]], int(lengths[i]), lane)[0] for i in short], np.uint64)
        result.append(np.concatenate([grams, own]))
    owner = np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    return owner[order], [x[order] for x in result]
