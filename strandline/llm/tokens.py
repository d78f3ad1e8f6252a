"""Token-id output: documents as token ids in wavelet-matrix shards (operator 11).

Documents are dealt into ranges of ascending id; each range is tokenised as a stream and cut into shards of
whole documents. A shard is one file: a header, the ids and ends of its documents, and for each bit of a token
id one plane of the wavelet matrix with the counts of ones before every 512 bits, each part compressed by zstd.
The matrix answers from that one file: which token stands here, how often a token occurs in a stretch, where it
occurs. Files are written and read by Spark (its text writer puts the bytes and one line feed; its binary reader
takes them), so any store that Spark reaches will do, and a task that is repeated leaves no half-written file.

Tokenising is by the tokenizers library. Its byte-level pattern always cuts before a space that a visible
character follows, between a letter or digit and a mark (but not after an apostrophe), and around a line feed
that stands alone between visible characters, so a text is the sequence of such pieces; distinct pieces of a
chunk are tokenised once and the pieces of earlier chunks are remembered, up to ``KNOWN_BYTES``.

Defined cases: a null or empty text is the end token alone; ids may be null (first) or repeated: rows of one id
are ordered by a hash of their text, equal rows by their place in the input; invalid UTF-8 is replaced by U+FFFD;
strings of special tokens within a text are ordinary text; an empty table gives no shards and no rows. Other
columns are not read. A shard exceeds ``shard_tokens`` only where one document does; a task holds one shard and
one chunk of text.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, packing, words

MAGIC = b"wavelet1"
SHARD_TOKENS = 1 << 20
KNOWN_BYTES = 16 << 20
_PIECE = 1 << 18
#: Bits of a plane for one stored count of ones.
SUPERBLOCK = 512

#: First bytes after a space that surely begin a visible character.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0xC3:0xF5] = True
_VISIBLE[0xE1:0xE4] = False
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_MARK &= ~_ALNUM


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that surely begin, and that surely end, a letter or digit: ASCII and U+00C0 to U+017F."""
    begin = _ALNUM[data]
    end = begin.copy()
    if len(data) > 1:
        lead, rest = data[:-1], data[1:]
        wide = (lead >= 0xC3) & (lead <= 0xC5)
        at = np.flatnonzero(wide)
        at = at[(lead[at] != 0xC3) | (rest[at] >= 0x80) & (rest[at] != 0x97) & (rest[at] != 0xB7)]
        begin[at] = end[at + 1] = True
    return begin, end


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 text at which the tokenizer's pattern surely begins anew, each by the bytes around it."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) < 2:
        return cut
    begin, end = _letters(data)
    mark = _MARK[data]
    inner = cut[1:-1]
    inner |= end[:-1] & mark[1:]
    inner |= mark[:-1] & (data[:-1] != 39) & begin[1:]
    cut[:-2] |= (data[:-1] == 32) & _VISIBLE[data[1:]]
    line = np.flatnonzero(data[1:-1] == 10) + 1
    line = line[(end | mark)[line - 1] & (begin | mark)[line + 1]]
    cut[line] = cut[line + 1] = True
    return cut


class Tokenizer:
    """Token ids of many texts at once; remembers the pieces that it has seen."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_str(definition)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab()
        #: Each character of a byte-level token stands for one byte.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _run(self, data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of pieces that stand in a row and are tokenised as if each stood alone, and how many each has."""
        counts, found, i = np.zeros(len(at) - 1, np.int64), [], 0
        while i < len(counts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + _PIECE, "right")) - 1)
            ids = np.array(self.library.encode_batch_fast([data[at[i] : at[j]].tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            counts[i:j] = np.diff(np.searchsorted(np.cumsum(self.width[ids]), at[i : j + 1] - at[i], "right"))
            found.append(ids)
            i = j
        return found, counts

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Remembers new pieces and gives their places among the known."""
        data, at = words.buffer_of(pieces)
        begin, end = _letters(data)
        mark, head, last = _MARK[data], at[:-1], at[1:] - 1
        spaced = np.zeros(len(pieces), bool)
        long = np.flatnonzero(np.diff(at) > 1)
        spaced[long] = (data[at[long]] == 32) & _VISIBLE[data[at[long] + 1]]
        # visible at both ends: a line feed before each keeps them apart
        lined = ~spaced & (begin | mark)[head] & (end | mark)[last]
        groups = [np.flatnonzero(x) for x in (~spaced & ~lined, lined, spaced)]
        order = np.concatenate(groups)
        pieces, counts, found = pieces.take(pa.array(order)), [], []
        data, at = words.buffer_of(pieces)
        alone, own = len(groups[0]), len(groups[0]) + len(groups[1])
        texts = [data[at[i] : at[i + 1]].tobytes().decode() for i in range(alone)]
        if texts:
            found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts.append(np.array([len(x) for x in found], np.int64))
        if own > alone:
            first = at[alone : own + 1] - at[alone]
            ids, many = self._run(np.insert(data[at[alone] : at[own]], first[:-1], 10), first + np.arange(len(first)))
            flat = np.concatenate(ids)
            found.append(np.delete(flat, np.cumsum(many) - many))
            counts.append(many - 1)
        ids, many = self._run(data[at[own] :], at[own:] - at[own])
        self.flat = np.concatenate([self.flat, *found, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([*counts, many]))])
        place = np.empty(len(order), np.int64)
        place[order] = len(self.known) + np.arange(len(order))
        self.known = pa.concat_arrays([self.known, pieces])
        return place

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and n + 1 positions at which the texts begin."""
        data, at = words.buffer_of(column)
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            data, at = words.buffer_of(pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:])], pa.string()))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        cut = _cuts(data)
        tails = at[1:-1][at[1:-1] > 0] - 1
        cut[tails[data[tails] == 32]] = False  # what follows a text's last space is not of that text
        cut[at] = True
        places = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        if self.known.nbytes > KNOWN_BYTES:
            self.forget()
        where = pc.index_in(pieces.dictionary, value_set=self.known)
        found = where.fill_null(-1).to_numpy().astype(np.int64)
        if where.null_count:
            found[found < 0] = self._learn(pieces.dictionary.filter(where.is_null()))
        each = found[pieces.indices.to_numpy()]
        sizes = np.diff(self.ends)[each]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.ends[each] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(places, at)]


@lru_cache(1)
def _tokenizer(definition: str) -> Tokenizer:
    """A worker's tokenizer: it outlives tasks, and so do the pieces that it knows."""
    return Tokenizer(definition)


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, size: int, ones: np.ndarray, blocks: np.ndarray):
        self.size, self.words = size, ones
        inner = np.cumsum(np.bitwise_count(ones.reshape(-1, SUPERBLOCK // 64)).astype(np.int64), axis=1)
        self.before = np.concatenate([[0], (inner + blocks.astype(np.int64)[:, None]).ravel()])
        self.zeros = size - int(self.before[-1])

    @staticmethod
    def pack(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits in 64-bit words, filled up to whole superblocks, and the ones before each superblock."""
        padded = np.zeros(max(1, -(-len(bits) // SUPERBLOCK)) * SUPERBLOCK, np.uint8)
        padded[: len(bits)] = bits
        ones = np.packbits(padded, bitorder="little").view(np.uint64)
        each = np.bitwise_count(ones.reshape(-1, SUPERBLOCK // 64)).sum(axis=1, dtype=np.int64)
        return ones, np.cumsum(each) - each

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.size, bitorder="little")

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = np.minimum(at >> 6, len(self.words) - 1)
        inside = np.where(at >> 6 < len(self.words), self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)), self.words[word])
        return self.before[word] + np.bitwise_count(inside)

    def select(self, bit: bool, nth: np.ndarray) -> np.ndarray:
        """The position of the nth one (or zero), counted from 0."""
        heads = self.before if bit else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(heads, nth, "right") - 1
        left = self.words[word] if bit else ~self.words[word]
        skip = (nth - heads[word]).astype(np.int64)
        at = np.zeros(len(nth), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((left >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            over = skip >= low
            at, skip = at + over * width, skip - over * low
        return word * 64 + at


def _zeros_first(bits: np.ndarray) -> np.ndarray:
    """The places of zeros, then those of ones: much faster to take by than two masks."""
    return np.concatenate([np.flatnonzero(~bits), np.flatnonzero(bits)])


class Wavelet:
    """A wavelet matrix: token access, counting and occurrences."""

    def __init__(self, size: int, planes: list[Plane]):
        self.size, self.planes = size, planes

    @classmethod
    def build(cls, tokens: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Packed planes, the highest bit first; after each, zeros stand before ones."""
        parts, width = [], max(1, int(tokens.max(initial=0)).bit_length())
        tokens = tokens.astype(np.uint16 if width <= 16 else np.uint32)
        for b in reversed(range(width)):
            bits = tokens & tokens.dtype.type(1 << b) != 0
            parts.append(Plane.pack(bits))
            tokens = tokens.take(_zeros_first(bits))
        return parts

    def access(self, at: np.ndarray) -> np.ndarray:
        """The tokens at these positions."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for plane in self.planes:
            bit, ones = plane.get(at), plane.rank(at)
            at = np.where(bit, plane.zeros + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return out

    def tokens(self) -> np.ndarray:
        """All tokens: planes are undone from the lowest bit up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.size, kind)
        for b, plane in enumerate(reversed(self.planes)):
            bits = plane.bits().astype(bool)
            back = np.empty_like(out)
            out[plane.zeros :] |= kind(1 << b)
            back[_zeros_first(bits)] = out
            out = back
        return out.astype(np.uint32)

    def _span(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        ends = np.array([low, high], np.int64)
        for b, plane in zip(reversed(range(len(self.planes))), self.planes):
            ones = plane.rank(ends)
            ends = plane.zeros + ones if token >> b & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token in a stretch."""
        first, end = self._span(token, low, self.size if high is None else high)
        return end - first

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, ascending."""
        at = np.arange(*self._span(token, 0, self.size))
        for b, plane in enumerate(reversed(self.planes)):
            at = plane.select(True, at - plane.zeros) if token >> b & 1 else plane.select(False, at)
        return at


def pack_shard(part: int, number: int, start: int, ids: list, ends: np.ndarray, tokens: np.ndarray) -> bytes:
    """A shard file. ``start`` counts the tokens of the shards before it in the same range of ids."""
    null = np.array([i is None for i in ids], np.uint8)
    sections = [packing.pack(np.array([i or 0 for i in ids], np.int64)), packing.zip_bytes(null.tobytes()), packing.pack(ends.astype(np.int64))]
    planes = Wavelet.build(tokens)
    for ones, blocks in planes:
        sections += [packing.zip_bytes(ones.tobytes()), packing.pack(blocks.astype(np.int64))]
    header = json.dumps({"part": part, "number": number, "start": start, "documents": len(ids), "tokens": len(tokens), "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *sections])


class Shard:
    """A shard file, opened; planes are unpacked when first asked for."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        at = len(MAGIC) + 4
        size = int.from_bytes(content[at - 4 : at], "little")
        self.header = json.loads(content[at : at + size])
        at, self._sections = at + size, []
        for length in self.header["sections"]:
            self._sections.append(content[at : at + length])
            at += length
        null = packing.unzip_bytes(self._sections[1])
        self.ids = [None if gone else int(i) for i, gone in zip(packing.unpack(self._sections[0], np.int64), null)]
        self.ends = packing.unpack(self._sections[2], np.int64)
        self._wavelet: Wavelet | None = None

    @property
    def wavelet(self) -> Wavelet:
        if self._wavelet is None:
            parts = self._sections[3:]
            planes = [Plane(self.header["tokens"], np.frombuffer(packing.unzip_bytes(a), np.uint64), packing.unpack(b, np.int64)) for a, b in zip(parts[::2], parts[1::2])]
            self._wavelet = Wavelet(self.header["tokens"], planes)
        return self._wavelet


def _shards(definition, end_token: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = _tokenizer(definition.value), TaskContext.get().partitionId()
        number = start = held = 0
        ids: list = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(tokens)
            return packing.record(content=([pack_shard(part, number, start, ids, np.cumsum(np.concatenate(sizes)), flat)], pa.binary()))

        for batch in batches:
            for chunk in words.chunks(batch, "text", common.BATCH_BYTES):
                plain, first = tokenizer.encode(chunk.column("text"))
                flat = np.insert(plain, first[1:], np.uint32(end_token))
                first = first + np.arange(len(first))
                own, row = chunk.column("doc_id").to_pylist(), 0
                while row < len(own):
                    room = first[row] + shard_tokens - held
                    upto = int(np.searchsorted(first, room, "right")) - 1
                    if upto <= row and held:
                        yield shard()
                        number, start, held, ids, sizes, tokens = number + 1, start + held, 0, [], [], []
                        continue
                    upto = max(upto, row + 1)
                    ids += own[row:upto]
                    sizes.append(np.diff(first[row : upto + 1]))
                    tokens.append(flat[first[row] : first[upto]])
                    held += int(first[upto] - first[row])
                    row = upto
        if held:
            yield shard()

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_token: int = 0, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes the token ids of all documents, each closed by ``end_token``, as shard files in ascending id order.

    File names ascend with the ids that the files hold. ``tokenizer`` is a file of the tokenizers library; the
    driver reads it and hands it to the tasks.
    """
    spark = docs.sparkSession
    common.bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"__h": F.xxhash64("text"), "__n": F.monotonically_increasing_id()})
    parts = min(common.buckets_for(rows, common.text_bytes(rows, "text"), 32 << 20), common.MOST_TASKS)
    order = ("doc_id", "__h", "__n")
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    with open(tokenizer, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    files = rows.mapInArrow(_shards(definition, end_token, shard_tokens), "content binary")
    files.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def _opened(work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                if len(held := content.as_py()) > 1:  # Spark writes an empty file for a table without rows
                    yield work(Shard(held))
                    words.release()

    return run


def _from_shards(spark: SparkSession, folder: str, work, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder).select("content")
    common.bounded_batches(files)
    return files.mapInArrow(_opened(work), schema)


def _placed(rows: DataFrame) -> DataFrame:
    """Replaces starts within a range of ids by starts within all; ``rows`` must not be costly to read again."""
    # one row for each range, MOST_TASKS at most: small enough for one task and for a broadcast
    totals = rows.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n"))
    before = totals.select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document in the shards: ``doc_id, start, n_tokens, ids_crc32``."""

    def work(shard: Shard) -> pa.RecordBatch:
        flat, ends, head = shard.wavelet.tokens().astype("<u4"), shard.ends, shard.header
        first = np.concatenate([[0], ends[:-1]])
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(first, ends)]
        return packing.record(part=(np.full(len(ends), head["part"], np.int32), pa.int32()), doc_id=(shard.ids, pa.int64()), start=(first + head["start"], pa.int64()), n_tokens=(ends - first, pa.int64()), ids_crc32=(sums, pa.int64()))

    return _placed(common.cut(_from_shards(spark, folder, work, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids themselves: ``doc_id, tokens`` (array of integers, end token included)."""

    def work(shard: Shard) -> pa.RecordBatch:
        flat = shard.wavelet.tokens().astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], shard.ends]).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64()), lists], ["doc_id", "tokens"])

    return _from_shards(spark, folder, work, "doc_id long, tokens array<int>")


def token_occurrences(spark: SparkSession, folder: str, wanted: list[int]) -> DataFrame:
    """Where tokens occur: ``token, doc_id, position`` (within the document), by rank and select in each file."""

    def work(shard: Shard) -> pa.RecordBatch:
        first = np.concatenate([[0], shard.ends[:-1]])
        token, owner, place = [], [], []
        for t in wanted:
            at = shard.wavelet.occurrences(t)
            doc = np.searchsorted(shard.ends, at, "right")
            token.append(np.full(len(at), t)), owner.append(doc), place.append(at - first[doc])
        ids = [shard.ids[d] for d in np.concatenate([np.zeros(0, np.int64), *owner])]
        return packing.record(token=(np.concatenate([np.zeros(0, np.int64), *token]), pa.int64()), doc_id=(ids, pa.int64()), position=(np.concatenate([np.zeros(0, np.int64), *place]), pa.int64()))

    return _from_shards(spark, folder, work, "token long, doc_id long, position long")


def op11_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Writes the token ids of ``documents`` as shards and reads each document's place and checksum back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{common.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(common.table(spark, sf_dir, "documents"), folder, tokenizer)
    return read_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
