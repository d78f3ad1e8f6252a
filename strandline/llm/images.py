"""Local image descriptors for a media column (operator 7).

Corners (Harris) at several scales get an orientation from the intensity centroid and a 256-bit string of
brightness tests turned by it. Bits are cut into eight tables of 32: descriptors that share a cut in one
table are candidates, and those within ``most_bits`` differing bits match. Matches of an image pair vote
for a rotation, a scale and a shift; ``votes`` of different places in one cell make the pair copies of each other, so
crops, brightness changes and light noise are found and single look-alike corners are not.

Corners come from a pyramid of five levels over one octave, so copies resized to half or twice the size are
found too. Images with equal pixels are one class and are described and searched once. The queries' descriptors
go to where the images are and votes are counted there, so that only found pairs travel; where they are too many, both sides are joined on
(table, cut), common cuts salted.

All corners above the response threshold count, however many, and all their cuts. Still a search by tables is
not exhaustive: two descriptors within ``most_bits`` differing bits meet only if one of their eight cuts is equal.

Images are binary PGM (P5, one byte a pixel). Defined cases: null, empty or broken images have no corners,
are a class each by content (null is one) and match nothing; images under 24 pixels a side have no corners;
repeated rows share a class; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .packing import record

_HEAD = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")
_RADIUS = 9
#: A pyramid over one octave: levels of two images meet at ratios of 0.5 to 2, at most 1.09 apart.
SCALES = tuple(2 ** (-k / 4) for k in range(5))
_tests = np.random.default_rng(31)
_A, _B = (np.clip(_tests.normal(0, 3.5, (256, 2)), -_RADIUS + 1, _RADIUS - 1) for _ in range(2))
_disc = np.stack(np.meshgrid(np.arange(-_RADIUS, _RADIUS + 1), np.arange(-_RADIUS, _RADIUS + 1)), -1).reshape(-1, 2)
_DISC = _disc[(_disc**2).sum(axis=1) <= _RADIUS**2]


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(pixels, 0, 255).astype(np.uint8).tobytes()


def read_pgm(data: bytes | None) -> np.ndarray | None:
    if not data or not (m := _HEAD.match(data)):
        return None
    width, height = int(m[1]), int(m[2])
    body = data[m.end() :]
    return np.frombuffer(body, np.uint8, width * height).reshape(height, width).astype(np.float32) if len(body) >= width * height > 0 else None


def _blur(x: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        x = (np.roll(x, 1, axis) + 2 * x + np.roll(x, -1, axis)) / 4
    return x


def _resize(x: np.ndarray, factor: float) -> np.ndarray:
    rows, cols = ((np.arange(int(n * factor)) + 0.5) / factor - 0.5 for n in x.shape)
    r, c = np.clip(rows, 0, x.shape[0] - 1.001), np.clip(cols, 0, x.shape[1] - 1.001)
    i, j = r.astype(int), c.astype(int)
    a, b = (r - i)[:, None], (c - j)[None, :]
    return (1 - a) * ((1 - b) * x[i][:, j] + b * x[i][:, j + 1]) + a * ((1 - b) * x[i + 1][:, j] + b * x[i + 1][:, j + 1])


def describe(pixels: np.ndarray, scales: tuple[float, ...] = SCALES) -> tuple[np.ndarray, np.ndarray]:
    """Corners as rows (x, y, angle, size) in the image's own pixels, and their 32-byte descriptors."""
    found, bits = [], []
    for scale in scales:
        x = _blur(pixels if scale == 1.0 else _resize(pixels, scale))
        edge = _RADIUS + 1
        if min(x.shape) < 2 * edge + 4:
            continue
        gy, gx = np.gradient(x)
        xx, yy, xy = _blur(_blur(gx * gx)), _blur(_blur(gy * gy)), _blur(_blur(gx * gy))
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = corner[edge:-edge, edge:-edge]
        top = np.max([corner[edge + dy : corner.shape[0] - edge + dy, edge + dx : corner.shape[1] - edge + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        r, c = np.nonzero((inner == top) & (inner > 1.0))
        r, c = r + edge, c + edge
        patch = x[r[:, None] + _DISC[:, 1], c[:, None] + _DISC[:, 0]]
        # sums and products in place of matrix products: those would start threads of their own in each worker
        angle = np.arctan2((patch * _DISC[:, 1]).sum(axis=1), (patch * _DISC[:, 0]).sum(axis=1))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        side = []
        for points in (_A, _B):
            right, down = (np.rint(v).astype(int) for v in (cos * points[:, 0] - sin * points[:, 1], sin * points[:, 0] + cos * points[:, 1]))
            side.append(x[np.clip(r[:, None] + down, 0, x.shape[0] - 1), np.clip(c[:, None] + right, 0, x.shape[1] - 1)])
        found.append(np.stack([c / scale, r / scale, angle, np.full(len(r), 1 / scale)], -1))
        bits.append(np.packbits(side[0] < side[1], axis=1))
    return (np.concatenate(found), np.concatenate(bits)) if found else (np.zeros((0, 4)), np.zeros((0, 32), np.uint8))


_PLACE = pa.schema([("x", pa.float32()), ("y", pa.float32()), ("angle", pa.float32()), ("size", pa.float32())])
_WORDS = [f"b{i}" for i in range(4)]
_PAIRS = 1 << 20
#: Images that a task describes.
_IMAGES = 500
_SALTS = 32


def _described(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    for name, data in zip(batch.column("class"), batch.column("image")):
        pixels = read_pgm(data.as_py())
        if pixels is not None and len((found := describe(pixels))[0]):
            yield name.as_py(), found[0].astype(np.float32), found[1]


def _descriptors(images: DataFrame) -> DataFrame:
    """One row for each corner of distinct images (``class, image``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, places, bits in _described(batch):
                words, cuts = bits.view(np.int64), bits.view(np.int32)
                yield record(
                    **{"class": ([name] * len(bits), pa.binary()), "k": (np.arange(len(bits)), pa.int32())}, **{f.name: (places[:, i], f.type) for i, f in enumerate(_PLACE)},
                    **{b: (words[:, i], pa.int64()) for i, b in enumerate(_WORDS)}, cuts=(cuts.tolist(), pa.list_(pa.int32())),
                )

    return images.select("class", "image").mapInArrow(run, "class binary, k int, x float, y float, angle float, size float, b0 long, b1 long, b2 long, b3 long, cuts array<int>")


def _packed(group: np.ndarray, *parts: tuple[np.ndarray, int]) -> np.ndarray:
    """One number for each row of a group and signed parts of so many bits."""
    out = group.astype(np.int64)
    for values, bits in parts:
        out = (out << bits) | (values.astype(np.int64) & ((1 << bits) - 1))
    return out


def _counts(group: np.ndarray, x: np.ndarray, y: np.ndarray, cell: float) -> np.ndarray:
    """Different places, cells of (x, y), by group."""
    return np.bincount(np.unique(_packed(group, (np.floor(x / cell), 16), (np.floor(y / cell), 16))) >> 32)


def _votes(query: np.ndarray, at: np.ndarray, to: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries of one image's matches, their most votes and all their places; as in ``_voted``."""
    turn, grow = to[:, 2] - at[:, 2], to[:, 3] / at[:, 3]
    dx = to[:, 0] - grow * (np.cos(turn) * at[:, 0] - np.sin(turn) * at[:, 1])
    dy = to[:, 1] - grow * (np.sin(turn) * at[:, 0] + np.cos(turn) * at[:, 1])
    around, size = np.floor(np.mod(turn + 0.26, 6.283185307) / 0.5236), np.rint(2 * np.log2(grow))
    asked, number = np.unique(query, return_inverse=True)
    spots = np.concatenate([_packed(number, (around, 4), (size, 5), (np.floor(dx / cell + i), 16), (np.floor(dy / cell + j), 16)) for i in (0.0, 0.5) for j in (0.0, 0.5)])
    cells, owner = np.unique(spots, return_inverse=True)
    votes = np.minimum(*(_counts(owner, np.tile(x[:, 0], 4), np.tile(x[:, 1], 4), cell) for x in (at, to)))
    first = np.searchsorted(cells >> 41, np.arange(len(asked)))
    return asked, np.maximum.reduceat(votes, first), _counts(number, at[:, 0], at[:, 1], cell)


def _found_here(asked: pa.Table, images: DataFrame, most_bits: int, cell: float, votes: int, share: float) -> DataFrame:
    """Rows ``q_class, class, votes, places``, counted where the images are, so that no match travels.

    Queries whose matches in an image have fewer than ``votes`` places cannot get so many votes and are left out.
    """
    cuts = np.array(asked.column("cuts").to_pylist(), np.int32).reshape(-1, 8)
    order = np.argsort(cuts, axis=0, kind="stable")
    own = (np.take_along_axis(cuts, order, 0), order, np.stack([asked.column(b).to_numpy() for b in _WORDS], -1).view(np.uint64), *_numbered(asked))
    shared = images.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, order, words, classes, owner, spots = shared.value
        for batch in batches:
            for name, places, bits in _described(batch):
                mine, keys, hits = bits.view(np.uint64), bits.view(np.int32), []
                for table in range(8):
                    low, high = (np.searchsorted(cuts[:, table], keys[:, table], side) for side in ("left", "right"))
                    ends = np.cumsum(high - low)
                    start = 0
                    while start < len(ends):  # some corners at a time, about so many pairs
                        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, "right")))
                        many = (high - low)[start:end]
                        k = np.repeat(np.arange(start, end), many)
                        q = order[np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + low[k], table]
                        ok = np.bitwise_count(words[q] ^ mine[k]).sum(axis=1, dtype=np.int64) <= most_bits
                        hits.append(np.stack([q[ok], k[ok]], -1))
                        start = end
                pairs = np.concatenate(hits)
                key = np.unique(pairs[:, 0] * len(bits) + pairs[:, 1])
                q, k = key // len(bits), key % len(bits)
                for here in (False, True):
                    if len(q):
                        x = places[k] if here else spots[q]
                        enough = _counts(owner[q], x[:, 0], x[:, 1], cell)[owner[q]] >= votes
                        q, k = q[enough], k[enough]
                if len(q):
                    own, most, many = _votes(owner[q], spots[q], places[k].astype(np.float64), cell)
                    good = (most >= votes) & (most >= share * many)
                    own, most, many = own[good], most[good], many[good]
                    yield record(q_class=([classes[i] for i in own], pa.binary()), **{"class": ([name] * len(own), pa.binary())}, votes=(most, pa.int64()), places=(many, pa.int64()))

    return images.select("class", "image").mapInArrow(run, "q_class binary, class binary, votes long, places long")


def _numbered(asked: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The classes, and by descriptor the number of its class and its place."""
    coded = asked.column("class").combine_chunks().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.stack([asked.column(n).to_numpy().astype(np.float64) for n in _PLACE.names], -1)


def _near_joined(asked: DataFrame, index: DataFrame, most_bits: int) -> DataFrame:
    """Matching corners by a join on (table, cut), for queries too many to go to all tasks."""
    q, t = (x.select("*", F.posexplode("cuts").alias("table", "cut")).drop("cuts") for x in (asked, index))
    q = q.select(*(F.col(c).alias(f"q_{c}") for c in q.columns if c not in ("table", "cut")), "table", "cut")
    # cuts of little contrast are common: the index's are dealt over _SALTS, the queries' go to each
    ones = F.bit_count(F.col("cut").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    hot = (ones <= 2) | (ones >= 30)
    t = t.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("class", "k"), F.lit(_SALTS)).cast("int")).otherwise(0))
    q = q.withColumn("salt", F.explode(F.when(hot, F.array(*map(F.lit, range(_SALTS)))).otherwise(F.array(F.lit(0)))))
    near = q.join(t, ["table", "cut", "salt"])
    differ = sum((F.bit_count(F.col(f"q_{b}").bitwiseXOR(F.col(b))) for b in _WORDS), F.lit(0))
    return near.where(differ <= most_bits).drop("table", "cut", "salt", *_WORDS, *(f"q_{b}" for b in _WORDS)).dropDuplicates(["q_class", "q_k", "class", "k"])


def _voted(near: DataFrame, cell: float) -> DataFrame:
    """Rows ``q_class, class, votes, places`` of joined matches."""
    turn, grow = F.col("angle") - F.col("q_angle"), F.col("size") / F.col("q_size")
    dx = F.col("x") - grow * (F.cos(turn) * F.col("q_x") - F.sin(turn) * F.col("q_y"))
    dy = F.col("y") - grow * (F.sin(turn) * F.col("q_x") + F.cos(turn) * F.col("q_y"))
    # a corner found at several levels votes once, and corners alike in one image are one too: places count, on both sides;
    # a turn of a few degrees moves far corners, so shifts vote in the two nearest cells each way
    spots = near.select("q_class", "class", *(F.struct(F.floor(F.col(x) / cell).alias("i"), F.floor(F.col(y) / cell).alias("j")).alias(n) for n, x, y in (("q_place", "q_x", "q_y"), ("place", "x", "y"))), F.floor(F.pmod(turn + 0.26, F.lit(6.283185307)) / 0.5236).alias("turn"), F.rint(2 * F.log2(grow)).alias("grow"), F.explode(F.array(*[F.struct(F.floor(dx / cell + i).alias("i"), F.floor(dy / cell + j).alias("j")) for i in (0.0, 0.5) for j in (0.0, 0.5)])).alias("c"))
    half = F.struct("turn", "grow", "c")
    counted = spots.groupBy("q_class", "class", half.alias("cell")).agg(F.least(F.countDistinct("q_place"), F.countDistinct("place")).alias("votes"))
    best = counted.groupBy("q_class", "class").agg(F.max("votes").alias("votes"))
    return best.join(spots.groupBy("q_class", "class").agg(F.countDistinct("q_place").alias("places")), ["q_class", "class"])


def search(queries: DataFrame, index: DataFrame, *, most_bits: int = 56, votes: int = 4, cell: float = 8.0, share: float = 0.2, most_cuts: int = 2_000_000) -> DataFrame:
    """Rows ``query, class, votes``: classes of ``index`` that hold a cropped or edited copy of a query.

    Both frames are distinct images, ``class, image``.
    """
    common.bounded_batches(index)
    asked = common.cut(_descriptors(queries))
    if 8 * asked.count() <= most_cuts:
        found = _found_here(asked.toArrow(), index, most_bits, cell, votes, share)
    else:
        found = _voted(common.cut(_near_joined(asked, _descriptors(index), most_bits)), cell)
    # look-alike corners scatter over the cells; with hundreds of them some cell gets a few votes by chance
    kept = found.where((F.col("votes") >= votes) & (F.col("votes") >= share * F.col("places")))
    return kept.select(F.col("q_class").alias("query"), "class", "votes")


def by_content(rows: DataFrame) -> DataFrame:
    """Adds ``class``, a 16-byte digest of the image; null is a class of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [blake2b(d.as_py(), digest_size=16).digest() if d.is_valid else b"" for d in batch.column("image")]
            yield record(id=(batch.column("id"), pa.int64()), image=(batch.column("image"), pa.binary()), **{"class": (digests, pa.binary())})

    return rows.mapInArrow(run, "id long, image binary, class binary")


# The test tables hold no images: each vector of ``embeddings`` is drawn as one, and every id divisible by 50
# asks for an edited copy (a crop, brighter, with noise) of its image.


def draw(vector: np.ndarray, side: int = 72) -> np.ndarray:
    """Rectangles whose places and shades depend on the vector alone."""
    rng = np.random.default_rng(zlib.crc32(np.round(np.asarray(vector, np.float64), 4).astype("<f4").tobytes()))
    out = np.full((side, side), 128.0)
    for x, y, w, h, shade in zip(*rng.integers([[0], [0], [6], [6], [0]], [[side - 6], [side - 6], [26], [26], [256]], (5, 28))):
        out[y : y + h, x : x + w] = shade
    return out


def edited(pixels: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(int(pixels.sum()) & 0xFFFFFFFF)
    top, left = rng.integers(0, 12, 2)
    crop = pixels[top : top + 58, left : left + 58] * 0.9 + 12
    return crop + rng.normal(0, 2, crop.shape)


def drawn(embeddings: DataFrame, edit: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                pictures = [draw(np.array([x if x is not None else 0.0 for x in v.as_py()], np.float64)) if v.is_valid else None for v in part.column("embedding")]
                yield record(id=(part.column("id"), pa.int64()), image=([None if p is None else write_pgm(edited(p) if edit else p) for p in pictures], pa.binary()))

    return embeddings.select(F.col("vec_id").cast("long").alias("id"), "embedding").mapInArrow(run, "id long, image binary")


def op7_image_copies(spark, sf_dir: str) -> DataFrame:
    """Classes of equal images, and for ids divisible by 50 the classes that an edited copy is found in."""
    rows = common.table(spark, sf_dir, "embeddings")
    index = common.cut(by_content(drawn(rows)).select("id", "class"))
    asked = common.cut(by_content(drawn(rows.where(F.col("vec_id") % 50 == 0), edit=True)))
    classes = index.groupBy("class").agg(F.min("id").alias("class_id"))
    # pixels are drawn again for one image of each class; stored, they would be many times the vectors
    chosen = rows.join(classes, F.col("vec_id") == F.col("class_id"), "left_semi")
    # by number: describing an image takes milliseconds, its vector has few bytes
    tasks = common.buckets_for(rows, index.count(), _IMAGES)
    pictures = by_content(drawn(chosen.repartition(min(tasks, common.MOST_TASKS), "vec_id"))).select("class", "image")
    found = search(asked.groupBy("class").agg(F.first("image").alias("image")), pictures)
    named = found.join(classes, "class").groupBy("query").agg(F.array_sort(F.collect_list("class_id")).alias("matches"), F.max("votes").alias("votes"))
    answers = asked.select(F.col("id").alias("vec_id"), F.col("class").alias("query")).join(named, "query", "left").drop("query")
    out = index.select(F.col("id").alias("vec_id"), "class").join(classes, "class").join(answers, "vec_id", "left")
    return out.select("vec_id", "class_id", (F.col("vec_id") % 50 == 0).alias("is_query"), F.coalesce("matches", F.array().cast("array<long>")).alias("matches"), F.coalesce("votes", F.lit(0)).cast("int").alias("votes"))
