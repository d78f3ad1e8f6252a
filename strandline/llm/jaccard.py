"""N-gram Jaccard join with token-group matrices (operator 2).

The link between two texts is exact: the shingle sets A and B link when ``den * |A & B| >= num * |A | B|``.

1. Equal sets collapse into one node. Every node lists its rarest shingles, as many as two linked sets
   cannot avoid sharing (the prefix filter; the order is by corpus frequency, then hash, and any common
   order is exact). Frequencies are counted over all texts; shingles seen ``common_from`` times or more
   come last.
2. Nodes that share a listed shingle are candidates. Size and position bounds, then a bound from parity
   bitmaps (each differing shingle flips one bit, so differing bits bound the difference from below),
   drop those that cannot link. Lists of more than ``list_limit`` nodes are not paired: their nodes join
   one family by a link to the least of them.
3. Candidates' components are families. A family's sets go through a token-group matrix: members in order
   of their least shingle form groups of similar sets, each group keeps the union of its shingles; a
   member's overlap with the union bounds its overlap with each set inside, and only groups that pass the
   bound are opened and counted exactly. Groups whose members are all linked to the member need no look.
   A family of more than ``block`` shingles in all is dealt out in pairs of blocks of similar set sizes;
   pairs whose sizes rule out a link are left out.
4. Links found connect nodes; components of those are the classes.

No pair of equal texts is made, and no pair of members in a large list; only exact links enter a class.

Defined cases: null text or text without words has an empty set, is linked with nothing and is a class of
its own; a text of fewer than ``n`` words has one shingle of all its words; rows that share an id are
texts of their own, and their class is named by the least id in it; null ids count as the least of all
and name a class null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, words
from .graph import components
from .packing import by_bucket, pack, record, split_by, unpack

_NO_ID = -(1 << 63)
_MOST_COMMON = 1_000_000
#: Bytes of text, and of packed tokens in a bucket, that a task holds at once.
_PART, _BUCKET = 2 << 20, 5 << 20
#: Packed bytes of counted tokens and of listed ones, by bytes of text, at most.
_COUNTED, _LISTED = 0.6, 0.6


def _sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: text numbers and hashes, sorted by both."""
    data, at = words.buffer_of(part.column("text"))
    owner, (hashes,) = words.shingles(words.LOWER[data], at, n)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def _least_overlap(a, b, num: int, den: int):
    """Shared shingles that a link between sets of these sizes needs."""
    return -(-num * (a + b) // (den + num))


# 1a. frequencies


def _count(n: int, bits: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, limit=_PART):
                _, hashes = _sets(part, n)
                tokens, times = np.unique(hashes >> np.uint64(64 - bits), return_counts=True)
                place = ((tokens >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                if out := [(b, pack(tokens[g]), pack(times[g].astype(np.int32))) for b, g in split_by(place)]:
                    b, t, c = zip(*out)
                    yield record(bucket=(b, pa.int64()), tokens=(t, pa.binary()), times=(c, pa.binary()))

    return run


def _frequent(least: int):
    def work(rows: list[dict]) -> pa.RecordBatch | None:
        tokens = np.concatenate([unpack(r["tokens"], np.uint64) for r in rows])
        times = np.concatenate([unpack(r["times"], np.int32) for r in rows])
        order = np.argsort(tokens, kind="stable")
        tokens, times = tokens[order], times[order]
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sums = np.add.reduceat(times.astype(np.int64), head)
        keep = sums >= least
        return record(token=(tokens[head][keep].astype(np.int64), pa.int64()), times=(sums[keep], pa.int64())) if keep.any() else None

    return by_bucket(work)


def common_tokens(rows: DataFrame, n: int, bits: int, least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (the upper ``bits`` of shingle hashes) that occur ``least`` times or more, with their counts.

    At most a million rows come to the driver: where there are more, ``least`` doubles. That changes the
    order of tokens and so the number of candidates, never a result.
    """
    buckets = common.buckets_for(rows, _COUNTED * size, _BUCKET)
    dealt = rows.mapInArrow(_count(n, bits, buckets), "bucket long, tokens binary, times binary")
    found = common.cut(common.by_key(dealt, buckets, "bucket").mapInArrow(_frequent(least), "token long, times long"))
    scale = {r["k"]: r["n"] for r in found.groupBy(F.floor(F.log2(F.col("times") / least)).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    k = 0
    while sum(v for u, v in scale.items() if u >= k) > _MOST_COMMON:
        k += 1
    got = found.where(F.col("times") >= least * 2**k).toArrow()
    tokens, times = got.column("token").to_numpy().astype(np.uint64), got.column("times").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order]


# 1b. nodes


def _describe(n: int, bits: int, num: int, den: int, shared):
    """Per text its set's size, signature, prefix tokens in the common order, and parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in batches:
            for part in words.chunks(batch, limit=_PART):
                owner, hashes = _sets(part, n)
                rows = part.num_rows
                size = np.bincount(owner, minlength=rows)
                first = np.concatenate([[0], np.cumsum(size)])
                sign = [np.add.reduceat(np.append(words.mix(hashes ^ np.uint64(salt)), np.uint64(0)), first[:-1]) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                tokens = hashes >> np.uint64(64 - bits)
                spot = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                rank = np.where(known[spot] == tokens, often[spot], 0) if len(known) else np.zeros(len(tokens), np.int64)
                order = np.lexsort((hashes, rank, owner))
                length = np.where(size > 0, size - -(-num * size // den) + 1, 0)
                ordered = tokens[order]
                spread = words.mix(hashes)
                prefixes, maps = [], []
                for i in range(rows):
                    a, b = first[i], first[i + 1]
                    prefixes.append(ordered[a : a + length[i]].tobytes())
                    width = 1 << max(6, int(b - a - 1).bit_length()) if b > a else 64
                    maps.append(np.packbits(np.bincount((spread[a:b] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes())
                empty = size == 0
                yield record(
                    node=(part.column("node"), pa.int64()), id=(part.column("id"), pa.int64()), size=(size, pa.int64()),
                    s1=(np.where(empty, 0, sign[0].view(np.int64)), pa.int64()), s2=(np.where(empty, 0, sign[1].view(np.int64)), pa.int64()),
                    prefix=(prefixes, pa.binary()), parity=(maps, pa.binary()),
                )

    return run


_DESCRIBED = "node long, id long, size long, s1 long, s2 long, prefix binary, parity binary"


# 2. candidates


def _post(bits: int, buckets: int):
    """Postings (token, place, node, size) by token range, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "prefix", _PART):
                data, at = words.buffer_of(part.column("prefix"))
                length = np.diff(at) // 8
                tokens = np.frombuffer(data.tobytes(), np.uint64)
                owner = np.repeat(np.arange(part.num_rows), length)
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(length) - length, length)
                order = np.argsort(tokens, kind="stable")
                tokens, owner, place = tokens[order], owner[order], place[order]
                node, size = part.column("node").to_numpy()[owner], part.column("size").to_numpy()[owner]
                bucket = ((tokens >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                out = [(b, pack(tokens[g]), pack(place[g].astype(np.int32)), pack(node[g]), pack(size[g].astype(np.int32))) for b, g in split_by(bucket)]
                if out:
                    yield record(**{k: (v, pa.int64() if k == "bucket" else pa.binary()) for k, v in zip(("bucket", "token", "place", "node", "size"), zip(*out))})

    return run


def _pairs(num: int, den: int, limit: int):
    """Candidate pairs (a < b) of short lists that pass the size and position bounds; stars of long lists."""

    def work(rows: list[dict]) -> pa.RecordBatch | None:
        token, place, node, size = (np.concatenate([unpack(r[k], t) for r in rows]) for k, t in (("token", np.uint64), ("place", np.int32), ("node", np.int64), ("size", np.int32)))
        order = np.lexsort((node, token))
        token, place, node, size = token[order], place[order].astype(np.int64), node[order], size[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(head, len(token)))
        start, run = np.repeat(head, count), np.repeat(count, count)
        star = (run > limit) & (np.arange(len(token)) != start)
        found = [np.stack([node[start[star]], node[star], np.ones(star.sum(), np.int64)])]
        few = (run > 1) & (run <= limit)
        token, place, node, size = token[few], place[few], node[few], size[few]
        for step in range(1, min(limit, len(token))):
            same = np.flatnonzero(token[step:] == token[:-step])
            if not len(same):
                break
            i, j = same, same + step
            need = _least_overlap(size[i], size[j], num, den)
            fits = (den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j])) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= need)
            i, j = i[fits], j[fits]
            found.append(np.stack([node[i], node[j], np.zeros(len(i), np.int64)]))
        pairs = np.concatenate(found, axis=1)
        pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
        return record(a=(pairs[0], pa.int64()), b=(pairs[1], pa.int64()), star=(pairs[2], pa.int64())) if pairs.shape[1] else None

    return by_bucket(work)


def _bitmap_filter(num: int, den: int):
    """Keeps pairs whose parity bitmaps leave room for a link, and all stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for star, sa, sb, pa_, pb in zip(*(batch.column(k).to_pylist() for k in ("star", "size_a", "size_b", "parity_a", "parity_b"))):
                x, y, bits = int.from_bytes(pa_, "little"), int.from_bytes(pb, "little"), 8 * max(len(pa_), len(pb))
                least = 8 * min(len(pa_), len(pb))
                while bits > least:  # folds the wider bitmap
                    bits //= 2
                    if len(pa_) * 8 > least:
                        x = (x >> bits) ^ (x & ((1 << bits) - 1))
                    else:
                        y = (y >> bits) ^ (y & ((1 << bits) - 1))
                keep.append(star > 0 or (x ^ y).bit_count() <= sa + sb - 2 * _least_overlap(sa, sb, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


# 3. families


def _matrix_join(node: list[int], tokens: list[np.ndarray], num: int, den: int, group: int) -> Iterator[tuple[int, int]]:
    """Links that connect the members, at most one for each two parts that it joins."""
    order = sorted(range(len(node)), key=lambda i: (int(tokens[i][0]), node[i]))
    node, tokens = [node[i] for i in order], [tokens[i] for i in order]
    size = np.array([len(t) for t in tokens])
    parent = list(range(len(node)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    groups = [range(i, min(i + group, len(node))) for i in range(0, len(node), group)]
    flat = [np.concatenate([tokens[i] for i in g]) for g in groups]
    inside = [np.repeat(np.arange(len(g)), size[g.start : g.stop]) for g in groups]
    unions = [np.unique(f) for f in flat]
    cells = np.concatenate(unions)
    of = np.repeat(np.arange(len(groups)), [len(u) for u in unions])
    by_token = np.argsort(cells, kind="stable")
    cells, of = cells[by_token], of[by_token]
    smallest = np.array([size[g.start : g.stop].min() for g in groups])
    one = [False] * len(groups)  # groups that are known to be one part
    for q, own in enumerate(tokens):
        low, high = np.searchsorted(cells, own, "left"), np.searchsorted(cells, own, "right")
        reach = high - low
        spots = np.repeat(low, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        overlap = np.bincount(of[spots], minlength=len(groups))
        need = _least_overlap(len(own), np.maximum(smallest, -(-num * len(own) // den)), num, den)
        for g in np.flatnonzero(overlap >= need).tolist():
            members = groups[g]
            if members.start >= q:
                break
            mine = root(q)
            if one[g]:
                if root(members.start) == mine:
                    continue
            elif members.stop <= q and all(root(i) == mine for i in members):
                one[g] = True
                continue
            place = np.minimum(np.searchsorted(own, flat[g]), len(own) - 1)
            shared = np.bincount(inside[g][own[place] == flat[g]], minlength=len(members))
            linked = den * shared >= num * (len(own) + size[members.start : members.stop] - shared)
            for k in np.flatnonzero(linked).tolist():
                i = members.start + k
                if i < q and root(i) != root(q):
                    parent[root(q)] = root(i)
                    yield node[i], node[q]


def _open_families(n: int, num: int, den: int, group: int):
    """Rows come sorted by task; a task is a family, or two blocks of one."""

    def settle(rows: dict[int, np.ndarray]) -> pa.RecordBatch | None:
        found = list(_matrix_join(list(rows), list(rows.values()), num, den, group))
        return record(a=([a for a, _ in found], pa.int64()), b=([b for _, b in found], pa.int64())) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            for part in words.chunks(batch):
                owner, hashes = _sets(part, n)
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                for i, (family, k1, k2, node) in enumerate(zip(*(part.column(k).to_pylist() for k in ("family", "k1", "k2", "node")))):
                    if now != (family, k1, k2):
                        if len(rows) > 1 and (out := settle(rows)) is not None:
                            yield out
                        now, rows = (family, k1, k2), {}
                    rows[node] = hashes[first[i] : first[i + 1]].copy()
        if len(rows) > 1 and (out := settle(rows)) is not None:
            yield out

    return run


def _tasks(families: DataFrame, sizes: DataFrame, block: int, num: int, den: int) -> DataFrame:
    """Rows ``node, family, k1, k2``: the tasks that a member takes part in.

    A member weighs its shingles, and no less than 256; a family within ``block`` is one task. A larger one
    falls into blocks of half that weight by size, and each two blocks whose sizes allow a link are a task.
    """
    weight = F.greatest("size", F.lit(256))
    members = families.join(sizes, "node")
    weights = members.groupBy("family").agg(F.sum(weight).alias("family_weight"))
    members = members.join(weights, "family")
    small = members.where(F.col("family_weight") <= block).select("node", "family", F.lit(0).alias("k1"), F.lit(0).alias("k2"))
    upto = F.sum(weight).over(Window.partitionBy("family").orderBy("size", "node"))
    large = members.where(F.col("family_weight") > block).withColumn("side", F.floor(upto / (block // 2)).cast("int"))
    blocks = large.groupBy("family", "side").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    meet = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.side") <= F.col("y.side")) & (den * F.col("x.high") >= num * F.col("y.low")))
    meet = meet.select(F.col("x.family").alias("family"), F.col("x.side").alias("k1"), F.col("y.side").alias("k2"))
    sides = meet.select("family", "k1", "k2", F.explode(F.array_distinct(F.array("k1", "k2"))).alias("side"))
    return small.unionByName(large.join(sides, ["family", "side"]).select("node", "family", "k1", "k2"))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, *, common_from: int = 50, list_limit: int = 64, group: int = 32, block: int = 2 << 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``id, node, size, class_id, class_node`` for every row of ``docs``.

    ``class_id`` is the least id that links reach; ``class_node`` names the row that stands for the class:
    the one whose ``node`` it equals.
    """
    common.bounded_batches(docs)
    sc = docs.sparkSession.sparkContext
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    twice = bool(docs.groupBy(own.alias("id")).count().where("count > 1").take(1))
    node = F.xxhash64(own, F.coalesce(F.col(text), F.lit(""))) if twice else own
    rows = docs.select(own.alias("id"), node.alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = common.text_bytes(docs, text)
    bits = min(63, max(40, math.ceil(math.log2(max(1, size))) + 12))
    shared = sc.broadcast(common_tokens(rows, n, bits, common_from, size))
    described = common.cut(rows.mapInArrow(_describe(n, bits, num, den, shared), _DESCRIBED))

    sets = described.groupBy("s1", "s2", "size").agg(F.min("node").alias("node"), F.min("id").alias("least_id"))
    keys = ("s1", "s2", "size")
    reps = described.where("size > 0").groupBy(*keys).agg(F.min("node").alias("node"), F.first("prefix").alias("prefix"))
    maps = described.where("size > 0").groupBy(*keys).agg(F.min("node").alias("node"), F.first("parity").alias("parity")).select("node", "size", "parity")
    buckets = common.buckets_for(docs, _LISTED * size, _BUCKET)
    dealt = reps.select("node", "size", "prefix").mapInArrow(_post(bits, buckets), "bucket long, token binary, place binary, node binary, size binary")
    pairs = common.by_key(dealt, buckets, "bucket").mapInArrow(_pairs(num, den, list_limit), "a long, b long, star long")
    pairs = pairs.groupBy("a", "b").agg(F.max("star").alias("star"))
    for side in ("a", "b"):
        pairs = pairs.join(maps.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("parity").alias(f"parity_{side}")), side)
    candidates = pairs.select("a", "b", "star", "size_a", "size_b", "parity_a", "parity_b").mapInArrow(_bitmap_filter(num, den), "a long, b long")
    families = components(candidates).select("node", F.col("component").alias("family"))

    tasks = common.cut(_tasks(families, sets.select("node", "size"), block, num, den))
    texts = rows.select("node", "text").join(tasks, "node")
    sorted_tasks = common.by_key(texts, common.buckets_for(docs, size), "family", "k1", "k2")
    links = sorted_tasks.mapInArrow(_open_families(n, num, den, group), "a long, b long")
    linked = components(links)

    classes = sets.join(linked, "node", "left").withColumn("class_node", F.coalesce("component", "node")).where("size > 0")
    named = classes.groupBy("class_node").agg(F.min("least_id").alias("class_id"))
    classes = classes.join(named, "class_node").select("s1", "s2", "size", "class_id", "class_node")
    out = described.select("id", "node", "size", "s1", "s2").join(classes, ["s1", "s2", "size"], "left")
    null_id = lambda c: F.when(c != _NO_ID, c)
    return out.select(null_id(F.col("id")).alias("id"), "node", "size", null_id(F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("class_node", "node").alias("class_node"))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Classes of ``documents`` whose 5-word shingle sets reach a Jaccard similarity of 0.8."""
    rows = near_duplicates(common.table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("class_id").alias("component_id"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM w UNION SELECT l.b AS a, r.c FROM r JOIN l ON l.a = r.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = w.doc_id"""
