"""Katz backoff language model, trained and evaluated in partitioned tables (operator 10).

Tokens are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one end token for each text. The model:

    P(w | h) = d(c) * c(h, w) / C(h)        where the pair was seen
             = alpha(h) * P(w)              else
    P(w)     = d(c) * c(w) / N              where the word was seen
             = U                            the share of all unseen words together

``d`` are Good-Turing discounts for counts up to ``k``; ``alpha(h)`` is what discounting leaves of h,
divided by the unigram mass of the words not seen after h, so each distribution sums to exactly one. A
context whose counts are all above ``k`` leaves nothing; its total counts one more, and that one is left.
A context never seen hands all to P(w). Where the counts of counts give no usable Good-Turing discount
(tiny corpora), 0.5 is taken off instead.

All words and all pairs have counts of their own. The figures of the at most ``frequent`` most frequent
words are broadcast; those of all others are looked up in tables. Where the line is drawn changes the work,
not the result. A word is told apart by 63 bits of its hash, a frequent one by its number.

Tables: pairs (h, w) by bucket. A pair whose w is frequent lies in the bucket of the pair's hash, so that
no word is one bucket; all pairs of another w lie in w's bucket, where c(w) is the sum of their counts.
Totals and backoff weights of other contexts lie in h's bucket. Texts are never joined with these: a chunk
of text sends each bucket its pairs with text numbers and repeats; the bucket answers with one sum for each
text and hands the pairs of other contexts on to their buckets, those of many chunks in one row; the
chunk's sums are added up.

Defined cases: null or empty text is its end token alone; without training texts every word is unseen;
repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .packing import by_bucket, pack, pack_plain, record, split_by, unpack, unpack_plain

#: Hashes have this bit, numbers of frequent words have not.
_HASHED = np.uint64(1 << 63)
END = np.uint64(0x0123456789ABCDEF) | _HASHED
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 4 << 20
_BINS = 16
#: Packed bytes of asked pairs by bytes of text.
_GROWTH = 0.9
#: Pairs of other contexts, of all chunks, that a task holds back to send or sum together.
_WAITING = 2_000_000
_WORDS = "bucket long, keys binary, counts binary"
_PAIRS = "bucket long, h binary, w binary, counts binary"
_CONTEXTS = "bucket long, h binary, total binary, left binary, mass binary"


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end token included, and the n + 1 positions where texts begin."""
    data, at = words.buffer_of(column)
    data = words.LOWER[data]
    starts, ends, first = words.word_table(data, at)
    out = np.full(len(starts) + len(at) - 1, END, np.uint64)
    texts = np.repeat(np.arange(len(at) - 1), np.diff(first))
    out[np.arange(len(starts)) + texts] = words.word_hashes(data, starts, ends) | _HASHED
    return out, first + np.arange(len(at))


def discounts(counts_of_counts: dict[int, int], k: int) -> np.ndarray:
    """d(0), d(1) .. d(k): Good-Turing, renormalised so that counts above k stay as they are."""
    n = [0] + [counts_of_counts.get(r, 0) for r in range(1, k + 2)]
    halved = np.array([0.0] + [(r - 0.5) / r for r in range(1, k + 1)])
    if not all(n[1:]):
        return halved
    rest = (k + 1) * n[k + 1] / n[1]
    d = np.array([0.0] + [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if rest < 1 else 1.0 for r in range(1, k + 1)])
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else halved


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


@dataclass
class Model:
    """What evaluation needs besides the tables; its size is bounded by the number of frequent words."""

    hashes: np.ndarray  # of the frequent words, sorted
    ids: np.ndarray  # of these hashes
    counts: np.ndarray  # by id
    total: int  # training tokens
    types: int  # distinct ones
    d1: np.ndarray
    base: float  # denominator of P(w)
    seen_mass: float
    d2: np.ndarray | None = None
    context_total: np.ndarray | None = None  # by id, the start of a text last
    alpha: np.ndarray | None = None

    @property
    def start(self) -> int:
        return len(self.counts)

    def codes(self, hashed: np.ndarray) -> np.ndarray:
        """Numbers of frequent words, hashes of all others."""
        if not len(self.hashes):
            return hashed
        spot = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == hashed, self.ids[spot].astype(np.uint64), hashed)

    def contexts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty_like(code)
        out[1:] = code[:-1]
        out[first[:-1]] = self.start
        return out

    def base_logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.types + 1)))

    def prob(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(counts, self.d1) / self.base, 1.0 - self.seen_mass)

    def word_counts(self, code: np.ndarray) -> np.ndarray:
        """Counts of frequent words; 0 for all others."""
        known = np.append(self.counts, 0)
        return known[np.minimum(code, np.uint64(self.start)).astype(np.int64)]


def _training_rows(docs: DataFrame, text: str, training) -> DataFrame:
    return docs.where(training).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Positions at which any of these differs from the row before."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _unique(keys: tuple[np.ndarray, ...], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of these columns, the first one leading the order, and the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = [key[order] for key in keys]
    head = _heads(*keys)
    if counts is None:
        return [key[head] for key in keys], np.diff(np.append(head, len(order)))
    return [key[head] for key in keys], np.add.reduceat(counts[order], head) if len(head) else counts[:0]


def _word_bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashed << np.uint64(1)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return words.mix(words.mix(h + _PAIR) * _PAIR + w)


def _pair_bucket(h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    return np.where(w < _HASHED, (_pair_keys(h, w) % np.uint64(buckets)).astype(np.int64), _word_bucket(w, buckets))


def _word_table(rows: DataFrame, buckets: int) -> DataFrame:
    """Counts of words: one row for each bucket, hashes ascending."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, limit=_CHUNK):
                keys, counts = np.unique(token_hashes(part.column("text"))[0], return_counts=True)
                out = [(b, pack(keys[g]), pack(counts[g].astype(np.int64))) for b, g in split_by(_word_bucket(keys, buckets))]
                if out:
                    b, k, c = zip(*out)
                    yield record(bucket=(b, pa.int64()), keys=(k, pa.binary()), counts=(c, pa.binary()))

    def merge(rows: list[dict]) -> pa.RecordBatch:
        keys, counts = (np.concatenate([unpack(r[n], t) for r in rows]) for n, t in (("keys", np.uint64), ("counts", np.int64)))
        (keys,), counts = _unique((keys,), counts)
        return record(bucket=([rows[0]["bucket"]], pa.int64()), keys=([pack(keys)], pa.binary()), counts=([pack(counts)], pa.binary()))

    dealt = common.by_key(rows.mapInArrow(count, _WORDS), buckets, "bucket")
    return common.cut(dealt.mapInArrow(by_bucket(merge), _WORDS))


def _pair_table(rows: DataFrame, shared, buckets: int) -> DataFrame:
    """Counts of pairs: one row for each bucket, in order of w, then h."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in words.chunks(batch, limit=_CHUNK):
                hashed, first = token_hashes(part.column("text"))
                code = m.codes(hashed)
                (w, h), counts = _unique((code, m.contexts(code, first)))
                out = [(b, pack_plain(h[g]), pack(w[g]), pack_plain(counts[g])) for b, g in split_by(_pair_bucket(h, w, buckets))]
                if out:
                    b, h, w, c = zip(*out)
                    yield record(bucket=(b, pa.int64()), h=(h, pa.binary()), w=(w, pa.binary()), counts=(c, pa.binary()))

    def merge(rows: list[dict]) -> pa.RecordBatch:
        h, w, counts = (np.concatenate([f(r[n], t) for r in rows]) for n, f, t in (("h", unpack_plain, np.uint64), ("w", unpack, np.uint64), ("counts", unpack_plain, np.int64)))
        (w, h), counts = _unique((w, h), counts)
        return record(bucket=([rows[0]["bucket"]], pa.int64()), h=([pack_plain(h)], pa.binary()), w=([pack(w)], pa.binary()), counts=([pack_plain(counts)], pa.binary()))

    dealt = common.by_key(rows.mapInArrow(count, _PAIRS), buckets, "bucket")
    return common.cut(dealt.mapInArrow(by_bucket(merge), _PAIRS))


def _histogram(table: DataFrame, read, k: int) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Counts of counts up to k + 1, and by sixteenth octave of the count: (types, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = read(batch.column("counts")[i].as_py(), np.int64)
                low, many = np.unique(counts[counts <= k + 1], return_counts=True)
                step = (np.log2(counts) * _BINS).astype(np.int64)
                bins, place = np.unique(step, return_inverse=True)
                yield record(exact=([True] * len(low) + [False] * len(bins), pa.bool_()), value=(np.concatenate([low, bins]), pa.int64()), types=(np.concatenate([many, np.bincount(place)]), pa.int64()), tokens=(np.concatenate([low * many, np.bincount(place, weights=counts).astype(np.int64)]), pa.int64()))

    got = table.mapInArrow(run, "exact boolean, value long, types long, tokens long").groupBy("exact", "value").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()
    return {r["value"]: r["types"] for r in got if r["exact"]}, {r["value"]: (r["types"], r["tokens"]) for r in got if not r["exact"]}


def _unigrams(table: DataFrame, frequent: int, k: int) -> Model:
    exact, bins = _histogram(table, unpack, k)
    total, types = sum(t for _, t in bins.values()), sum(n for n, _ in bins.values())
    cut, kept = max(bins, default=0) + 1, 0
    for b in sorted(bins, reverse=True):
        if kept + bins[b][0] > frequent:
            break
        cut, kept = b, kept + bins[b][0]

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = unpack(batch.column("keys")[i].as_py(), np.uint64), unpack(batch.column("counts")[i].as_py(), np.int64)
                keep = (np.log2(counts) * _BINS).astype(np.int64) >= cut
                yield record(key=(keys[keep].view(np.int64), pa.int64()), count=(counts[keep], pa.int64()))

    got = table.mapInArrow(most, "key long, count long").toArrow()
    hashes, counts = got.column("key").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], counts[order]
    by_hash = np.argsort(hashes)
    d1 = discounts(exact, k)
    low = {r: n for r, n in exact.items() if r <= k}
    mass = sum(r * n * d1[r] for r, n in low.items()) + total - sum(r * n for r, n in low.items())
    base = float(total) if mass < total else float(total + 1)
    return Model(hashes[by_hash], by_hash.astype(np.uint32), counts, total, types, d1, base, mass / base)


def _counts_of(m: Model, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """c(w) of each pair of a bucket, whose order is that of w."""
    head = _heads(w)
    sums = np.add.reduceat(counts, head) if len(head) else counts
    return np.where(w < _HASHED, m.word_counts(w), np.repeat(sums, np.diff(np.append(head, len(w)))))


def _weights(total: np.ndarray, left: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals and backoff weights: ``left`` is what discounting took, ``mass`` the P(w) of words seen."""
    bare = left <= 1e-9 * total
    held = np.where(bare, total + 1, total)
    return held, (left + bare) / held / np.maximum(1 - mass, 1e-12)


def _contexts(pairs: DataFrame, model: Model, k: int, buckets: int) -> DataFrame:
    """Adds the frequent contexts' totals and backoff weights to the model; the table of all others."""
    model.d2 = discounts(_histogram(pairs, unpack_plain, k)[0], k)
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def sums(batch: pa.RecordBatch, i: int, frequent: bool):
        m = shared.value
        h, w, counts = (f(batch.column(n)[i].as_py(), t) for n, f, t in (("h", unpack_plain, np.uint64), ("w", unpack, np.uint64), ("counts", unpack_plain, np.int64)))
        mass = m.prob(_counts_of(m, w, counts))
        keep = (h < _HASHED) == frequent
        counts, mass = counts[keep], mass[keep]
        h, place = np.unique(h[keep], return_inverse=True)
        return h, [np.bincount(place, weights=x, minlength=len(h)) for x in (counts, counts - _discounted(counts, m.d2), mass)]

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, (c, d, p) = sums(batch, i, True)
                yield record(h=(h.astype(np.int64), pa.int64()), c=(c, pa.float64()), d=(d, pa.float64()), p=(p, pa.float64()))

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, got = sums(batch, i, False)
                out = [(b, pack(h[g]), *(pack_plain(x[g]) for x in got)) for b, g in split_by(_word_bucket(h, buckets))]
                if out:
                    b, h, c, d, p = zip(*out)
                    yield record(bucket=(b, pa.int64()), h=(h, pa.binary()), total=(c, pa.binary()), left=(d, pa.binary()), mass=(p, pa.binary()))

    def merge(rows: list[dict]) -> pa.RecordBatch:
        h = np.concatenate([unpack(r["h"], np.uint64) for r in rows])
        order = np.argsort(h, kind="stable")
        h, head = h[order], _heads(h[order])
        held, alpha = _weights(*(np.add.reduceat(np.concatenate([unpack_plain(r[n], np.float64) for r in rows])[order], head) for n in ("total", "left", "mass")))
        return record(bucket=([rows[0]["bucket"]], pa.int64()), h=([pack(h[head])], pa.binary()), total=([pack_plain(held)], pa.binary()), left=([pack_plain(alpha)], pa.binary()), mass=([b""], pa.binary()))

    got = pairs.mapInArrow(few, "h long, c double, d double, p double").groupBy("h").agg(F.sum("c").alias("c"), F.sum("d").alias("d"), F.sum("p").alias("p")).toArrow()
    model.context_total, model.alpha = np.ones(model.start + 1), np.ones(model.start + 1)
    h, *figures = (got.column(n).to_numpy() for n in ("h", "c", "d", "p"))
    model.context_total[h], model.alpha[h] = _weights(*figures)
    dealt = common.by_key(pairs.mapInArrow(many, _CONTEXTS), buckets, "bucket")
    return common.cut(dealt.mapInArrow(by_bucket(merge), _CONTEXTS))


def train(docs: DataFrame, training, *, frequent: int = 65_000, k: int = 5, text: str = "text") -> tuple[Model, DataFrame, DataFrame, int]:
    """The model, its tables of pairs and of contexts, and their number of buckets."""
    common.bounded_batches(docs)
    buckets = common.buckets_for(docs, _GROWTH * common.text_bytes(docs, text), 16 << 20)
    rows = _training_rows(docs, text, training)
    model = _unigrams(_word_table(rows, buckets), frequent, k)
    pairs = _pair_table(rows, docs.sparkSession.sparkContext.broadcast(model), buckets)
    return model, pairs, _contexts(pairs, model, k, buckets), buckets


# kinds of rows: 0 a table, 1 what a chunk asks, 2 what is known of a chunk
_ASK = "bucket long, kind int, chunk long, h binary, w binary, texts binary, counts binary"
_SUMS = "bucket long, kind int, chunk long, source long, h binary, texts binary, score binary, more binary"


def _ask(shared, buckets: int):
    """Per chunk: its pairs with text numbers for each bucket, and one row of what frequent words settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, context = shared.value, TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 24
        for batch in batches:
            for part in words.chunks(batch, limit=_CHUNK):
                hashed, first = token_hashes(part.column("text"))
                code, n = m.codes(hashed), part.num_rows
                owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
                mine = code < _HASHED
                base = np.bincount(owner[mine], weights=m.base_logs(m.word_counts(code[mine])), minlength=n)
                known = np.bincount(owner[mine], minlength=n)
                ids = part.column("id")
                head = b"".join([ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.diff(first).astype(np.int64).tobytes(), known.astype(np.int64).tobytes(), base.tobytes()])
                (w, h, own), counts = _unique((code, m.contexts(code, first), owner))
                out = [(b, 1, chunk, pack_plain(h[g]), pack(w[g]), pack_plain(own[g]), pack_plain(counts[g])) for b, g in split_by(_pair_bucket(h, w, buckets))]
                b, kind, c, h, w, t, r = zip(*out, (-1, 2, chunk, head, b"", b"", b""))
                yield record(bucket=(b, pa.int64()), kind=(kind, pa.int32()), chunk=(c, pa.int64()), h=(h, pa.binary()), w=(w, pa.binary()), texts=(t, pa.binary()), counts=(r, pa.binary()))
                chunk += 1

    return run


def _found(table: np.ndarray, values: np.ndarray, asked: np.ndarray, missing) -> np.ndarray:
    if not len(table):
        return np.full(len(asked), missing, values.dtype)
    spot = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    return np.where(table[spot] == asked, values[spot], values.dtype.type(missing))


def _by_text(own: np.ndarray, *weights: np.ndarray) -> tuple[bytes, list[bytes]]:
    """Sums for the texts that occur."""
    texts = np.flatnonzero(np.bincount(own)).astype(np.int32)
    return pack(texts), [np.bincount(own, weights=x)[texts].tobytes() for x in weights]


def _sums(out: list[tuple]) -> pa.RecordBatch:
    b, kind, c, f, h, t, s, x = zip(*out)
    return record(bucket=(b, pa.int64()), kind=(kind, pa.int32()), chunk=(c, pa.int64()), source=(f, pa.int64()), h=(h, pa.binary()), texts=(t, pa.binary()), score=(s, pa.binary()), more=(x, pa.binary()))


def _answer_pairs(shared, buckets: int):
    """A bucket's pairs come first, then what chunks ask. Pairs of other contexts go on to these."""

    def handed_on(bucket: int, turn: int, waiting: list[tuple]) -> list[tuple]:
        """One row for each bucket of contexts, of all chunks that wait."""
        h, chunk, own, signed = (np.concatenate(x) for x in zip(*waiting))
        order = np.argsort(h, kind="stable")
        h, chunk, own, signed = h[order], chunk[order], own[order], signed[order]
        return [(b, 1, turn, bucket, pack(h[g]), pack_plain(own[g]), pack_plain(signed[g]), pack_plain(chunk[g])) for b, g in split_by(_word_bucket(h, buckets))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, now, waiting, many, turn = shared.value, None, [], 0, 0
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                bucket, kind, chunk, h, w, texts, counts = (batch.column(n)[i].as_py() for n in batch.schema.names)
                if kind == 2:
                    out.append((-1, 2, chunk, -1, b"", b"", h, b""))
                    continue
                if waiting and (bucket != now or many > _WAITING):
                    out += handed_on(now, turn, waiting)
                    waiting, many, turn = [], 0, turn + 1
                if bucket != now:
                    now, pairs, known, turn = bucket, empty, empty, 0
                    words.release()
                h, w, counts = unpack_plain(h, np.uint64), unpack(w, np.uint64), unpack_plain(counts, np.int64)
                if kind == 0:
                    keys, rare = _pair_keys(h, w), w >= _HASHED
                    order = np.argsort(keys)
                    head = _heads(w[rare])
                    known = w[rare][head], np.add.reduceat(counts[rare], head) if len(head) else counts[:0]
                    pairs = keys[order], counts[order]
                    continue
                own = unpack_plain(texts, np.int32)
                seen = _found(*pairs, _pair_keys(h, w), 0)
                rare, other = w >= _HASHED, h >= _HASHED
                of_word = np.where(rare, _found(*known, w, 0), m.word_counts(w))
                logs = np.where(seen > 0, _log(_discounted(seen, m.d2)), _log(m.prob(of_word)))
                at = np.minimum(h, np.uint64(m.start)).astype(np.int64)
                logs += np.where(other, 0.0, np.where(seen > 0, -_log(m.context_total[at]), _log(m.alpha[at])))
                named, (score, base, hit) = _by_text(own, logs * counts, np.where(rare, m.base_logs(of_word), 0.0) * counts, (rare & (of_word > 0)) * counts)
                out.append((bucket, 2, chunk, -1, b"", named, score, base + hit if rare.any() else b""))
                # the sign of the repeats says whether the pair was seen
                if other.any():
                    waiting.append((h[other], np.full(int(other.sum()), chunk), own[other], np.where(seen > 0, counts, -counts)[other]))
                    many += len(waiting[-1][0])
            if out:
                yield _sums(out)
        if waiting:
            yield _sums(handed_on(now, turn, waiting))

    return run


def _summed(bucket: int, turn: int, waiting: list[tuple]) -> list[tuple]:
    """One row for each chunk that waits, with a sum for each of its texts that occur."""
    chunk, own, logs = (np.concatenate(x) for x in zip(*waiting))
    order = np.lexsort((own, chunk))
    chunk, own, logs = chunk[order], own[order], logs[order]
    head = _heads(chunk, own)
    chunk, own, logs = chunk[head], own[head], np.add.reduceat(logs, head)
    at = np.append(_heads(chunk), len(chunk))
    return [(bucket, 2, int(chunk[i]), turn, b"", pack(own[i:j]), logs[i:j].tobytes(), b"") for i, j in zip(at[:-1], at[1:])]


def _answer_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's contexts come first, then what is asked of them; answers to chunks pass through."""
    now, waiting, many, turn = None, [], 0, 0
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            row = tuple(batch.column(n)[i].as_py() for n in ("bucket", "kind", "chunk", "source", "h", "texts", "score", "more"))
            bucket, kind, chunk, source, h, texts, score, more = row
            if kind == 2:
                out.append(row)
                continue
            if waiting and (bucket != now or many > _WAITING):
                out += _summed(now, turn, waiting)
                waiting, many, turn = [], 0, turn + 1
            if bucket != now:
                now, table, total, alpha, turn = bucket, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0
                words.release()
            h = unpack(h, np.uint64)
            if kind == 0:
                table, total, alpha = h, unpack_plain(score, np.float64), unpack_plain(more, np.float64)
                continue
            own, signed = unpack_plain(texts, np.int32), unpack_plain(score, np.int64)
            logs = np.where(signed > 0, -_log(_found(table, total, h, 1.0)), _log(_found(table, alpha, h, 1.0)))
            waiting.append((unpack_plain(more, np.int64), own, logs * np.abs(signed)))
            many += len(own)
        if out:
            yield _sums(out)
    if waiting:
        yield _sums(_summed(now, turn, waiting))


def _add(rows: list[dict]) -> pa.RecordBatch:
    """Sums of one chunk, the chunk's own row first, in an order that reruns repeat."""
    head = np.frombuffer(rows[0]["score"], np.int64).reshape(5, -1)
    ids, valid, tokens, known, base = head[0], head[1], head[2], head[3].copy(), head[4].view(np.float64).copy()
    score = np.zeros(len(ids))
    for r in rows[1:]:
        texts = unpack(r["texts"], np.int32)
        score[texts] += np.frombuffer(r["score"], np.float64)
        if r["more"]:
            more = np.frombuffer(r["more"], np.float64).reshape(2, -1)
            base[texts] += more[0]
            known[texts] += more[1].astype(np.int64)
    return record(id=([x if v else None for x, v in zip(ids.tolist(), valid.tolist())], pa.int64()), n_tokens=(tokens, pa.int64()), n_known=(known, pa.int64()), base_score=(base, pa.float64()), score=(score, pa.float64()))


def score(docs: DataFrame, model: Model, pairs: DataFrame, contexts: DataFrame, buckets: int, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``id, n_tokens, n_known, base_score, score`` for every row of ``docs``."""
    common.bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    table, minus, nothing = F.lit(0), F.lit(-1).cast("long"), F.lit(bytearray())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # rows about a chunk are dealt out by chunk, all others by bucket
    at = F.when(F.col("kind") == 2, -1 - F.col("chunk")).otherwise(F.col("bucket"))
    asked = rows.mapInArrow(_ask(shared, buckets), _ASK)
    known = pairs.select("bucket", table.alias("kind"), minus.alias("chunk"), "h", "w", nothing.alias("texts"), "counts")
    dealt = common.by_key(asked.unionByName(known).withColumn("at", at), buckets, "at", order=("kind", "chunk")).drop("at")
    sums = dealt.mapInArrow(_answer_pairs(shared, buckets), _SUMS)
    known = contexts.select("bucket", table.alias("kind"), minus.alias("chunk"), minus.alias("source"), "h", nothing.alias("texts"), F.col("total").alias("score"), F.col("left").alias("more"))
    dealt = common.by_key(sums.unionByName(known).withColumn("at", at), buckets, "at", order=("kind", "chunk", "source")).drop("at")
    added = common.by_key(dealt.mapInArrow(_answer_contexts, _SUMS), buckets, "chunk", order=("bucket", "source"))
    return added.mapInArrow(by_bucket(_add, "chunk"), "id long, n_tokens long, n_known long, base_score double, score double")


def op10_katz_score(spark, sf_dir: str) -> DataFrame:
    """log10 probabilities of ``documents`` under a model of those whose crc32 mod 5 is not 1."""
    docs = common.table(spark, sf_dir, "documents")
    model, pairs, contexts, buckets = train(docs, ~common.held_out("doc_id", 5, 1))
    rows = score(docs, model, pairs, contexts, buckets)
    return rows.select(F.col("id").alias("doc_id"), common.held_out("id", 5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
