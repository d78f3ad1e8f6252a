"""Benchmark decontamination with a distributed positional inverted index (operator 9).

The index is partitioned by document, as segments of some megabytes of text. A segment stores its terms
(64-bit word hashes, sorted), the postings of each term (word positions, ascending) and its documents'
ids and first positions. Segments are rows, so an index can be written as a table and searched later.

Search takes phrases. In each segment a phrase starts from the postings of its rarest term there, moved
by the term's offset; the lists of the other terms, from rare to common, are intersected with what is
left. What survives all terms and lies in one document is an exact match. A proximity search asks that
each term has a posting within some words of the rarest term's.

Phrases come to the executors in blocks of at most ``block_bytes`` of benchmark text; a larger benchmark
takes several passes over the stored index, whose hits are merged by document.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Defined cases: null or empty
texts have no words and no hits; an item of fewer words than a window is one window of all its words, one
without words none; items that share an id count once, and a null id is named by the empty string; repeated
documents are each reported; empty tables give no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words
from .packing import record

_INDEX = "ids binary, valid binary, firsts binary, terms binary, counts binary, postings binary"
_HITS = "row int, id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_MATCHES = "id long, item string, kind string, start int, length int"


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, and the n + 1 positions where each begins."""
    data, at = words.buffer_of(column)
    data = words.LOWER[data]
    starts, ends, first = words.word_table(data, at, words.NON_ALNUM)
    return words.word_hashes(data, starts, ends), first


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch):
            hashed, first = _tokens(part.column("text"))
            order = np.argsort(hashed, kind="stable").astype(np.int32)
            ranked = hashed[order]
            head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
            ids = part.column("id")
            values = [
                ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), first.astype(np.int32).tobytes(),
                ranked[head].tobytes(), np.diff(np.append(head, len(ranked))).astype(np.int32).tobytes(), order.tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["ids", "valid", "firsts", "terms", "counts", "postings"])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each segment of the index."""
    common.bounded_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_build, _INDEX)


class _Segment:
    def __init__(self, batch: pa.RecordBatch, i: int):
        read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        self.ids, self.valid, self.first = read("ids", np.int64), read("valid", bool), read("firsts", np.int32)
        self.terms, self.counts, self.postings = read("terms", np.uint64), read("counts", np.int32), read("postings", np.int32)
        self.size = len(self.postings)
        self.heads = np.cumsum(self.counts, dtype=np.int64) - self.counts
        #: all postings as one ascending list of (term, position)
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * np.int64(self.size + 1) + self.postings

    def next_posting(self, terms: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The first posting of each term at a position or after it; past a term's list: huge."""
        base = terms * np.int64(self.size + 1)
        at = np.searchsorted(self.keys, base + low)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] - base
        return np.where((at < len(self.keys)) & (found <= self.size), found, np.iinfo(np.int64).max)

    def look_up(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases all of whose terms occur: their numbers, terms and posting counts (past the end: huge)."""
        spot = np.minimum(np.searchsorted(self.terms, phrases), max(0, len(self.terms) - 1))
        inside = np.arange(phrases.shape[1]) < lengths[:, None]
        there = (self.terms[spot] == phrases) if len(self.terms) else np.zeros(phrases.shape, bool)
        live = np.flatnonzero((there | ~inside).all(axis=1) & (lengths > 0))
        return live, spot[live], np.where(inside[live], self.counts[spot[live]] if len(self.terms) else 0, np.iinfo(np.int32).max)

    def starts(self, terms: np.ndarray, counts: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In blocks: phrase numbers and the positions of their rarest terms."""
        rarest = counts.argmin(axis=1)
        rows = np.arange(len(rarest))
        many, head = counts[rows, rarest].astype(np.int64), self.heads[terms[rows, rarest]]
        upto, a = np.cumsum(many), 0
        while a < len(many):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, "right")))
            n = many[a:b]
            own = np.repeat(np.arange(a, b), n)
            yield own, self.postings[np.repeat(head[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
            a = b

    def phrases(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches: phrase numbers and first word positions."""
        live, terms, counts = self.look_up(phrases, lengths)
        if not len(live):
            return live, live
        order, size = np.argsort(counts, axis=1, kind="stable"), lengths[live]
        found = []
        for own, spot in self.starts(terms, counts):
            begin = spot - order[own, 0]
            keep = (begin >= 0) & (begin + size[own] <= self.size)
            own, begin = own[keep], begin[keep]
            for step in range(1, phrases.shape[1]):
                offset = order[own, step]
                keep = (step >= size[own]) | (self.next_posting(terms[own, offset], begin + offset) == begin + offset)
                own, begin = own[keep], begin[keep]
            doc = np.searchsorted(self.first, begin, "right") - 1
            keep = begin + size[own] <= self.first[doc + 1]
            found.append((live[own[keep]], begin[keep]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def near(self, phrases: np.ndarray, lengths: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrase numbers and positions of rarest terms that have all other terms within so many words."""
        live, terms, counts = self.look_up(phrases, lengths)
        if not len(live):
            return live, live
        found = []
        for own, spot in self.starts(terms, counts):
            for step in range(phrases.shape[1]):
                doc = np.searchsorted(self.first, spot, "right") - 1
                low, high = np.maximum(spot - within, self.first[doc]), np.minimum(spot + within, self.first[doc + 1] - 1)
                keep = (step >= lengths[live[own]]) | (self.next_posting(terms[own, step], low) <= high)
                own, spot = own[keep], spot[keep]
            found.append((live[own], spot))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def windows_of(items: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Phrases as rows of ``window`` term hashes, their lengths and items' numbers, and the items' names."""
    hashed, first = _tokens(items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string()))
    rows, lengths, owner = [], [], []
    for i in range(items.num_rows):
        own = hashed[first[i] : first[i + 1]]
        for k in range(max(1, len(own) - window + 1) if len(own) else 0):
            phrase = own[k : k + window]
            rows.append(np.pad(phrase, (0, window - len(phrase))))
            lengths.append(len(phrase))
            owner.append(i)
    return np.array(rows, np.uint64).reshape(-1, window), np.array(lengths, np.int64), np.array(owner, np.int64), [x if x is not None else "" for x in items.column("item").to_pylist()]


def _hits(shared):
    """Per document of a segment: its words, the spans that matches cover, and the items that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, lengths, item_of, names = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                seg = _Segment(batch, i)
                number, begin = seg.phrases(phrases, lengths)
                n_docs = len(seg.ids)
                depth = np.zeros(seg.size + 1, np.int32)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + lengths[number], -1)
                hit = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                # a span that reaches over the end of a document is two
                low, high = edge[::2], edge[1::2]
                cuts = seg.first[(seg.first > 0) & (seg.first < seg.size)].astype(np.int64)
                cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]]) if len(cuts) else cuts
                low, high = np.sort(np.concatenate([low, cuts])), np.sort(np.concatenate([high, cuts]))
                doc = np.searchsorted(seg.first, low, "right") - 1
                spans, items = [[] for _ in range(n_docs)], [set() for _ in range(n_docs)]
                for d, a, b in zip(doc.tolist(), low.tolist(), high.tolist()):
                    spans[d].append({"start": a - int(seg.first[d]), "end": b - int(seg.first[d])})
                for d, k in set(zip((np.searchsorted(seg.first, begin, "right") - 1).tolist(), item_of[number].tolist())):
                    items[d].add(names[k])
                yield record(
                    row=(np.arange(n_docs), pa.int32()), id=([x if v else None for x, v in zip(seg.ids.tolist(), seg.valid.tolist())], pa.int64()), n_words=(np.diff(seg.first), pa.int64()),
                    spans=(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), items=([sorted(x) for x in items], pa.list_(pa.string())),
                )

    return run


def _item_blocks(items: DataFrame, window: int, block_bytes: int, item_col: str, text: str) -> Iterator[tuple]:
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield blocks, windows_of(part.toArrow(), window)


def contaminated(index: DataFrame, items: DataFrame, window: int = 10, *, block_bytes: int = 4 << 20, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """Rows ``id, n_words, spans, items`` for every document of the index."""
    sc, stored, parts = index.sparkSession.sparkContext, None, []
    for blocks, phrases in _item_blocks(items, window, block_bytes, item_col, text):
        shared = sc.broadcast(phrases)
        if blocks == 1:
            return index.mapInArrow(_hits(shared), _HITS).drop("row")
        if stored is None:
            stored = common.cut(index.withColumn("segment", F.monotonically_increasing_id()))
        for_block = stored.select(F.struct("segment").alias("s"), *index.columns)
        parts.append(_with_segment(for_block, shared))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("segment", "row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).drop("segment", "row")


def _with_segment(stored: DataFrame, shared) -> DataFrame:
    work = _hits(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                segment = one.column("s")[0].as_py()["segment"]
                for out in work([one]):
                    yield pa.RecordBatch.from_arrays([pa.array([segment] * out.num_rows, pa.int64()), *out.columns], ["segment", *out.schema.names])

    return stored.mapInArrow(run, f"segment long, {_HITS}")


def search(index: DataFrame, items: DataFrame, window: int = 10, *, within: int | None = None, block_bytes: int = 4 << 20, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """Rows ``id, item, kind, start, length`` for each match: ``phrase``, or ``near`` where ``within`` is given."""
    sc, out = index.sparkSession.sparkContext, None
    for _, phrases in _item_blocks(items, window, block_bytes, item_col, text):
        shared = sc.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases, lengths, item_of, names = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    seg = _Segment(batch, i)
                    number, begin = seg.phrases(phrases, lengths) if within is None else seg.near(phrases, lengths, within)
                    doc = np.searchsorted(seg.first, begin, "right") - 1
                    yield record(
                        id=([int(seg.ids[d]) if seg.valid[d] else None for d in doc.tolist()], pa.int64()), item=([names[k] for k in item_of[number].tolist()], pa.string()),
                        kind=(["phrase" if within is None else "near"] * len(doc), pa.string()), start=((begin - seg.first[doc]).astype(np.int32), pa.int32()), length=(lengths[number].astype(np.int32), pa.int32()),
                    )

        part = index.mapInArrow(run, _MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def covered(spans: Column) -> Column:
    """Words that spans cover; spans of several blocks may overlap."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))
    return F.aggregate(ordered, start, step, lambda s: s["n"])


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside occurrences of 10-word windows of ``benchmark``."""
    rows = contaminated(build_index(common.table(spark, sf_dir, "documents")), common.table(spark, sf_dir, "benchmark"))
    n_hit = covered(F.col("spans"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[])"
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 8, 2) END)) AS i FROM b)),
m AS (SELECT DISTINCT m FROM q),
s AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d, m)),
h AS (SELECT DISTINCT s.doc_id, s.i, q.m, q.item_id FROM s JOIN q ON s.m = q.m AND s.p = q.p),
n AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
