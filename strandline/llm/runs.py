"""Periodic runs of words by a harmonic grid of longest-common-extension queries (operator 13).

A run is a stretch of words with smallest period p that is at least ``repeats`` periods and ``least`` words long
and that no neighbouring word extends. Such a run holds a grid point jp within its first p words, and (j+1)p
too; so for each p the common extensions of jp and (j+1)p, forward and backward, give every run. An extension is
the minimum of the array of longest common prefixes between two places of the suffix array, by a table of minima
over powers of two; the same on the reversed words extends backward. The grid of a text of n words has about
n ln n points; points whose words differ too early are passed over by the suffix sort's ranks.

Texts of a chunk share one suffix array in which a word of each text is a symbol of its own, so no extension
leaves its text. Most texts repeat no stretch that a run would need and leave after two rounds of sorting.

Nothing is shuffled: a text is worked on where it is read. Defined cases: a null or empty text, or one of spaces,
has no words and no runs; ids may be null or repeated, rows stay as they are; words are compared by their bytes.
Memory is about 8 * log2(longest repeat) + 8 * log2(n) bytes a word of one chunk (1 MB of text, or one longer text).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

CHUNK_BYTES = 1 << 20
_PAIRS = 1 << 20

#: For the ids of a chunk and their numbers of words: for each word the number, within its text, of the word to read there.
Reading = Callable[[list, np.ndarray], np.ndarray]


def ranks(symbols: np.ndarray, most: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ or ``most`` levels are made.

    Suffixes alike so far share the rank of the first of them. Also the positions whose rank is still shared.
    """
    size = len(symbols)
    levels: list[np.ndarray] = []
    places, key, base = np.arange(size), symbols, None
    while len(places):
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(new)
        counts = np.diff(np.concatenate([heads, [len(places)]]))
        rank = np.repeat(heads, counts)
        if base is not None:  # ranks within a class of the level before follow that class's own rank
            parent = base[order]
            first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            rank = parent + rank - np.repeat(first, np.diff(np.concatenate([first, [len(places)]])))
        level = levels[-1].copy() if levels else np.empty(size, np.int32)
        level[places] = rank
        levels.append(level)
        places = places[np.repeat(counts > 1, counts)]
        if most is not None and len(levels) == most:
            break
        after = places + (1 << (len(levels) - 1))
        base = level[places].astype(np.int64)
        key = base * (size + 1) + np.where(after < size, level[np.minimum(after, size - 1)] + 1, 0)
    return levels, places


class Extensions:
    """Longest common extensions of two positions: suffix array, longest common prefixes, minima over powers of two."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.levels, _ = ranks(symbols)
        self.size = size = len(symbols)
        self.rank = self.levels[-1]
        self.suffixes = np.empty(size, np.int32)
        self.suffixes[self.rank] = np.arange(size, dtype=np.int32)
        common_prefix = np.zeros(size, np.int32)
        at = 1 + np.flatnonzero(self.levels[0][self.suffixes[:-1]] == self.levels[0][self.suffixes[1:]])
        one, two, length = self.suffixes[at - 1].astype(np.int64), self.suffixes[at].astype(np.int64), np.zeros(len(at), np.int64)
        for k in reversed(range(len(self.levels) - 1)):
            a, b = one + length, two + length
            inside = (a < size) & (b < size)
            a[~inside] = b[~inside] = 0
            length += (inside & (self.levels[k][a] == self.levels[k][b])).astype(np.int64) << k
        common_prefix[at] = length
        self.least = [common_prefix]
        while 2 << (len(self.least) - 1) <= longest:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))

    def extension(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Symbols that follow both positions alike; the positions differ and lie in one text."""
        a, b = self.rank[one].astype(np.int64), self.rank[two].astype(np.int64)
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        power = np.frexp(b - a + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(power):
            own = np.flatnonzero(power == k)
            table = self.least[k]
            out[own] = np.minimum(table[a[own]], table[b[own] - (1 << int(k)) + 1])
        return out


def _smallest(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period): of those with one start and end, the least period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[keep]


def find_runs(codes: np.ndarray, first: np.ndarray, repeats: int, least: int) -> np.ndarray:
    """Runs of all texts: rows (start, end, period), ascending; positions count over all words of the chunk."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    symbols = owner * (int(codes.max(initial=0)) + 1) + codes
    # a run repeats a stretch of at least so many words within its text
    needed = min(max(least, repeats * p) - p for p in range(1, least + 1))
    _, shared = ranks(symbols, max(1, needed).bit_length())
    chosen = np.zeros(len(counts), bool)
    chosen[owner[shared]] = True
    if not chosen.any():
        return np.zeros((0, 3), np.int64)
    kept = np.flatnonzero(chosen[owner])
    counts = counts[chosen]
    begin = np.cumsum(counts) - counts
    symbols, total = symbols[kept], int(counts.sum())
    forward = Extensions(symbols, int(counts.max()))
    # ranks are grouped by text, since symbols are
    repeated = np.maximum.reduceat(forward.least[0], begin)
    most = np.minimum(counts // repeats, repeated // max(1, repeats - 1))
    text = np.repeat(np.arange(len(counts)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    level = np.frexp(np.maximum(1, (repeats - 2) * period))[1] - 1
    able = level < len(forward.levels)
    text, period, level = text[able], period[able], level[able]
    points = (counts[text] - 1) // period
    pairs = []
    ends, i = np.cumsum(points), 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - points[i] + _PAIRS, "right")))
        block = np.repeat(np.arange(i, j), points[i:j])
        step = np.arange(len(block)) - np.repeat(ends[i:j] - points[i:j] - (ends[i] - points[i]), points[i:j])
        left = begin[text[block]] + step * period[block]
        right = left + period[block]
        for k in np.unique(level[i:j]):
            own = np.flatnonzero(level[block] == k)
            own = own[forward.levels[k][left[own]] == forward.levels[k][right[own]]]
            pairs.append(np.stack([left[own], right[own]], axis=1))
        i = j
    forward.levels = []
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    if not len(pairs):
        return np.zeros((0, 3), np.int64)
    backward = Extensions(symbols[::-1], int(counts.max()))
    backward.levels = []
    found = [np.zeros((0, 3), np.int64)]
    for i in range(0, len(pairs), _PAIRS):
        left, right = pairs[i : i + _PAIRS].T
        ahead = forward.extension(left, right)
        back = np.zeros(len(left), np.int64)
        inner = np.flatnonzero(left > begin[np.searchsorted(begin, left, "right") - 1])
        back[inner] = backward.extension(total - left[inner], total - right[inner])
        p = right - left
        long = p + ahead + back >= np.maximum(least, repeats * p)
        found.append(_smallest(np.stack([left - back, right + ahead, p], axis=1)[long]))
    found = _smallest(np.concatenate(found))
    found[:, 1] = kept[found[:, 1] - 1] + 1
    found[:, 0] = kept[found[:, 0]]
    return found


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Per text its kept words, joined by one space."""
    upto = np.concatenate([[0], np.cumsum(keep)])[first]
    starts, sizes = starts[keep], (ends - starts)[keep] + 1
    last = upto[1:][np.diff(upto) > 0] - 1
    sizes[last] -= 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    out = data[np.minimum(source, len(data) - 1)] if len(data) else data
    spaces = np.ones(len(sizes), bool)
    spaces[last] = False
    out[at[1:][spaces] - 1] = 32
    return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(at[upto].astype(np.int32)), pa.py_buffer(out)])


def _runs(repeats: int, least: int, reading: Reading | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words.chunks(batch, "text", CHUNK_BYTES):
                data, at = words.buffer_of(chunk.column("text"))
                starts, ends, first = words.word_table(data, at)
                if reading is not None:
                    order = reading(chunk.column("id").to_pylist(), np.diff(first)) + np.repeat(first[:-1], np.diff(first))
                    starts, ends = starts[order], ends[order]
                # codes by the bytes of each word, as they stand one after the other
                sizes = ends - starts
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                letters = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
                codes = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)])
                codes = codes.dictionary_encode().indices.to_numpy().astype(np.int64)
                found = find_runs(codes, first, repeats, least)
                owner = np.searchsorted(first, found[:, 0], "right") - 1
                order = np.lexsort((found[:, 2], found[:, 0], owner))
                found, owner = found[order], owner[order]
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, found[:, 0] + found[:, 2], 1)
                np.add.at(change, found[:, 1], -1)
                keep = np.cumsum(change)[:-1] == 0
                columns = [found[:, 0] - first[owner], found[:, 1] - found[:, 0], found[:, 2]]
                each = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first))).astype(np.int32)), each)
                counts = pa.array(np.diff(first), pa.int64())
                yield pa.RecordBatch.from_arrays([chunk.column("id"), counts, lists, _joined(data, starts, ends, first, keep)], ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, repeats: int = 4, least: int = 6, reading: Reading | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id, n_words, runs, collapsed``.

    ``runs`` holds (start, length, period) by start, then period; ``collapsed`` is the text, its words joined by
    one space, without what follows the first period of a run. ``repeats`` is 2 at least.
    """
    if repeats < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    common.bounded_batches(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_runs(repeats, least, reading), f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(ids: list, counts: np.ndarray) -> np.ndarray:
    """The test pattern of the contract: a tenth of all texts, by crc32 of their id, end in repeats."""
    hashes = np.array([zlib.crc32(("null" if i is None else str(i)).encode()) for i in ids], np.int64)
    g = hashes // 10
    there = (hashes % 10 == 0) & (counts > 0)
    begin = np.where(there, g % np.maximum(counts, 1), counts)
    period = 1 + (counts - begin) // (3 + g % 8)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.where(at >= begin[owner], begin[owner] + (at - begin[owner]) % period[owner], at)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after the contract's planting; a null id counts as the text ``null``."""
    found = periodic_runs(common.table(spark, sf_dir, "documents"), reading=planted)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    found = found.withColumn("longest", longest)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
