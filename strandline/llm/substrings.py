"""Substring dedup by super-k-mers (operator 1).

A window is ``window`` consecutive words of one text. Each window has a minimiser: the smallest hash among
its runs of ``seed`` words. Consecutive windows with the same minimiser form a super-k-mer, one packed
string, which travels once to the minimiser's bucket instead of ``window`` times. Equal windows have equal
minimisers and meet in one bucket; sorting the bucket's windows finds all occurrences of each, and every
one but the first is a repeat. Only word ranges of repeats go back to the documents.

Map side, super-k-mers with equal strings in one chunk of text are settled there: the first travels, the
others are repeats already. So a passage that a third of all documents share reaches its bucket once for
each chunk, not for each document.

The number of buckets follows from the measured bytes of text. A task works on one bucket at a time and on
a bounded part of it: repeats of a part are settled, and only super-k-mers with a first occurrence go on to the
next part. So a passage that is everywhere takes the memory of one copy. Windows are compared by two independent
64-bit hashes of their words.

Defined cases: documents are ordered by id, a null id before all others; rows that share an id are
documents of their own, ordered by a hash of the text; rows alike in id and text are one document twice, and get the
same result. Null or empty text has no words. Other columns pass through ``dedup_documents`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words
from .packing import pack, split_by, unpack, unzip_bytes, zip_bytes

_NO_ID = -(1 << 63)
#: Bytes of super-k-mers by bytes of text: windows of 20 words share some 8 to a minimiser.
_GROWTH = 3.6
_PACKED = "bucket long, strings binary, doc binary, tie binary, start binary"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def super_kmers(data: np.ndarray, at: np.ndarray, window: int, seed: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Packed strings in order of text and place, with text number, first word and minimiser of each."""
    starts, ends, first = words.word_table(data, at)
    place, owner = words.gram_starts(first, window)
    none = np.zeros(0, np.int64)
    if not len(place):
        return [], none, none, none.astype(np.uint64)
    seeds = words.gram_hashes(words.word_hashes(data, starts, ends), seed)
    least = _sliding_min(seeds, window - seed + 1)[place]
    head = np.ones(len(place), bool)
    head[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
    at_head = np.flatnonzero(head)
    last = np.append(at_head[1:], len(place)) - 1
    # one byte buffer with the words of all texts joined by one space each
    lengths = ends - starts
    target = np.cumsum(lengths + 1) - (lengths + 1)
    joined = np.full(int(lengths.sum() + len(lengths)), 32, np.uint8)
    keep = ~words.SPACE[data]
    spot = np.ones(len(joined), bool)
    spot[target + lengths] = False
    joined[spot] = data[keep]
    raw = joined.tobytes()
    low, high = target[place[at_head]], target[place[last] + window - 1] + lengths[place[last] + window - 1]
    strings = [raw[a:b] for a, b in zip(low.tolist(), high.tolist())]
    return strings, owner[at_head], place[at_head] - first[owner[at_head]], least[at_head]


def _rows(kind: list) -> pa.RecordBatch:
    cols = list(zip(*kind))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "strings", "doc", "tie", "start"])


def _deal(window: int, seed: int, buckets: int):
    """Map side: super-k-mers by bucket, one row for each bucket and chunk; bucket -1 - b holds settled ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                doc, tie = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "t"))
                order = np.lexsort((tie, doc))
                if (order[1:] < order[:-1]).any():
                    part, doc, tie = part.take(pa.array(order)), doc[order], tie[order]
                strings, owner, start, least = super_kmers(*words.buffer_of(part.column("text")), window, seed)
                if not strings:
                    continue
                seen: dict[bytes, int] = {}
                firsts = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
                mine = np.arange(len(strings))
                known = firsts != mine
                same = known & (doc[owner[firsts]] == doc[owner]) & (tie[owner[firsts]] == tie[owner]) & (start[firsts] == start)
                bucket = (least % np.uint64(buckets)).astype(np.int64)
                out, travels = [], mine[~known]
                for b, found in split_by(bucket[travels]):
                    group = travels[found]
                    own = owner[group]
                    out.append((b, zip_bytes(b"\n".join([strings[i] for i in group.tolist()])), pack(doc[own]), pack(tie[own]), pack(start[group].astype(np.int32))))
                settled = mine[known & ~same]
                if len(settled):
                    own = owner[settled]
                    ends = np.array([strings[i].count(b" ") + 1 for i in settled.tolist()], np.int32) + start[settled].astype(np.int32)
                    out.append((-1 - int(bucket[settled[0]]), pack(ends), pack(doc[own]), pack(tie[own]), pack(start[settled].astype(np.int32))))
                if out:
                    yield _rows(out)

    return run


def _repeats(strings: list[bytes], doc: np.ndarray, tie: np.ndarray, start: np.ndarray, window: int):
    """Word ranges of all windows that occur earlier, and which super-k-mers hold a first occurrence.

    Sorts the windows and looks at neighbours.
    """
    data = np.frombuffer(b"\n".join(strings), np.uint8)
    breaks = np.flatnonzero(data == 10)
    at = np.concatenate([[0], breaks + 1, [len(data)]])
    starts, ends, first = words.word_table(data, at)
    place, owner = words.gram_starts(first, window)
    lanes = [words.gram_hashes(words.word_hashes(data, starts, ends, k), window, k)[place] for k in (0, 1)]
    begin = start[owner].astype(np.int64) + place - first[owner]
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((start, tie, doc))] = np.arange(len(doc))
    order = np.lexsort((begin, rank[owner], lanes[0]))
    h0, h1 = lanes[0][order], lanes[1][order]
    same = h0[1:] == h0[:-1]
    if (same & (h1[1:] != h1[:-1])).any():  # two windows share one hash: let the other decide as well
        order = np.lexsort((begin, rank[owner], lanes[1], lanes[0]))
        h0, h1 = lanes[0][order], lanes[1][order]
        same = (h0[1:] == h0[:-1]) & (h1[1:] == h1[:-1])
    head = np.concatenate([[True], ~same])
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    again = (doc[owner[leader]] == doc[owner[order]]) & (tie[owner[leader]] == tie[owner[order]]) & (begin[leader] == begin[order])
    repeat = np.zeros(len(order), bool)
    repeat[order] = ~head & ~again
    live = np.bincount(owner[order[head]], minlength=len(doc)) > 0
    hit = np.flatnonzero(repeat)
    cut = np.ones(len(hit), bool)
    cut[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
    low = hit[cut]
    high = hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1] if len(hit) else hit
    own = owner[low]
    return (doc[own], tie[own], begin[low], begin[high] + window), live


#: Bytes of super-k-mers that a task sorts at once.
_PART = 8 << 20


def _ranges(d: np.ndarray, t: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["d", "t", "s", "e"])


def _sort_buckets(window: int):
    """Reduce side: rows come sorted by bucket; a bounded part of one bucket is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, limit = None, [], 0, _PART

        def settle() -> pa.RecordBatch:
            nonlocal held, size, limit
            strings = [x for h in held for x in h[0]]
            doc, tie, start = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            found, live = _repeats(strings, doc, tie, start, window)
            strings = [strings[i] for i in np.flatnonzero(live).tolist()]
            held, size = [(strings, doc[live], tie[live], start[live])], sum(map(len, strings))
            limit = max(_PART, 2 * size)  # distinct text of a bucket is what it is; copies are not
            words.release()
            return _ranges(*found)

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, strings, *rest = (batch.column(n)[i].as_py() for n in ("bucket", "strings", "doc", "tie", "start"))
                doc, tie, start = (unpack(x, k) for x, k in zip(rest, (np.int64, np.int64, np.int32)))
                if bucket < 0:
                    yield _ranges(doc, tie, start, unpack(strings, np.int32))
                    continue
                if bucket != now:
                    if size:
                        yield settle()
                    now, held, size, limit = bucket, [], 0, _PART
                raw = unzip_bytes(strings)
                held.append((raw.split(b"\n"), doc, tie, start))
                size += len(raw)
                if size > limit:
                    yield settle()
        if size:
            yield settle()

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the words of its ranges, kept words joined by one space."""
    for batch in (p for b in batches for p in words.chunks(b)):
        texts, ranges = batch.column("text"), batch.column("ranges")
        n_words, n_removed, kept = [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            own = text.encode().split() if text else []
            taken = 0
            if ranges[i].is_valid and len(found := ranges[i].values):
                depth = np.zeros(len(own) + 1, np.int32)
                np.add.at(depth, found.field("s").to_numpy(), 1)
                np.add.at(depth, found.field("e").to_numpy(), -1)
                stay = np.cumsum(depth[:-1]) == 0
                taken = len(own) - int(stay.sum())
                n_words.append(len(own))
                own = [own[k] for k in np.flatnonzero(stay).tolist()]
            else:
                n_words.append(len(own))
            n_removed.append(taken)
            kept.append(b" ".join(own).decode())
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["d", "t", "id", "n_words", "n_removed", "kept"])


def _keys(docs: DataFrame, id_col: str, text: str) -> tuple[Column, Column]:
    """Order of a document: its id, then a hash of its text, which only counts where an id repeats."""
    common.bounded_batches(docs)
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    twice = bool(docs.groupBy(own.alias("d")).count().where("count > 1").take(1))
    return own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if twice else F.lit(0).cast("long")


def repeated_ranges(docs: DataFrame, window: int = 20, seed: int = 6, *, id_col: str = "doc_id", text: str = "text", keys: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows ``d, t, s, e``: words s to e - 1 of document (d, t) are covered by windows that start earlier."""
    d, t = keys or _keys(docs, id_col, text)
    rows = docs.select(d.alias("d"), t.alias("t"), F.col(text).cast("string").alias("text")).where("text is not null")
    buckets = common.buckets_for(docs, _GROWTH * common.text_bytes(docs, text), 8 << 20)
    dealt = rows.mapInArrow(_deal(window, seed, buckets), _PACKED)
    return common.by_key(dealt, buckets, "bucket").mapInArrow(_sort_buckets(window), "d long, t long, s int, e int")


def dedup(docs: DataFrame, window: int = 20, seed: int = 6, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``id, n_words, n_removed, kept`` (the words that stay, joined by one space) for every document."""
    d, t = keys = _keys(docs, id_col, text)
    found = repeated_ranges(docs, window, seed, id_col=id_col, text=text, keys=keys)
    ranges = found.groupBy("d", "t").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    rows = docs.select(d.alias("d"), t.alias("t"), F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.join(ranges, ["d", "t"], "left").mapInArrow(_cut_out, "d long, t long, id long, n_words long, n_removed long, kept string").select("id", "n_words", "n_removed", "kept")


def dedup_documents(docs: DataFrame, window: int = 20, seed: int = 6, *, id_col: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents, in their own columns, without repeated windows.

    A text that loses nothing stays as it is, line breaks included; one that loses words becomes its kept
    words joined by one space; a document of which nothing stays is dropped.
    """
    d, t = keys = _keys(docs, id_col, text)
    found = repeated_ranges(docs, window, seed, id_col=id_col, text=text, keys=keys)
    ranges = found.groupBy(F.col("d").alias("__d"), F.col("t").alias("__t")).agg(F.collect_list(F.struct("s", "e")).alias("__ranges"))
    rows = docs.withColumns({"__d": d, "__t": t})
    joined = rows.join(ranges, ["__d", "__t"], "left")
    shape = joined.drop("__d", "__t", "__ranges").schema
    at = shape.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in words.chunks(b, text)):
            part = pa.RecordBatch.from_arrays([batch.column("__d"), batch.column("__t"), batch.column("__d"), batch.column(text), batch.column("__ranges")], ["d", "t", "id", "text", "ranges"])
            out = pa.Table.from_batches(_cut_out([part])).combine_chunks()
            lost, total = out.column("n_removed").to_numpy(), out.column("n_words").to_numpy()
            new = [k if n else o for k, n, o in zip(out.column("kept").to_pylist(), lost.tolist(), batch.column(text).to_pylist())]
            columns = [batch.column(n) for n in shape.names]
            columns[at] = pa.array(new, batch.column(text).type)
            if n_chars in shape.names:
                i = shape.names.index(n_chars)
                sizes = [len(x) if n else o for x, n, o in zip(new, lost.tolist(), columns[i].to_pylist())]
                columns[i] = pa.array(sizes, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, shape.names).filter(pa.array((lost == 0) | (lost < total)))

    return joined.mapInArrow(run, shape)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Removes 20-word windows that occur earlier in ``documents``."""
    rows = dedup(common.table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS i, w FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS gone FROM x GROUP BY doc_id),
o AS (SELECT w.doc_id, w.w, coalesce(g.gone, []::BIGINT[]) AS gone FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
e AS (SELECT doc_id, len(w) AS n, len(gone) AS m, w, gone, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS p FROM o),
f AS (SELECT e.doc_id, any_value(n) AS n, any_value(m) AS m, string_agg(CASE WHEN e.p > 0 THEN e.w[e.p] END, ' ' ORDER BY e.p) FILTER (WHERE x.p IS NULL) AS kept FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.p = e.p GROUP BY e.doc_id)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM f"""
