"""Language identification by word-first backoff (operator 4).

A word that training knows scores by its log frequency in each language. An unknown word falls back to
its character 5-grams, then 4-grams, down to single characters: the longest length at which any of them
is known scores it, by the mean of their log frequencies. A text's language has the largest sum.

Words are runs of letters of the lower-cased text. Words and n-grams are known by 64-bit hashes, so a chunk
of texts takes a few array passes; only words that training has not seen become strings, once a chunk.

Fitting reads at most about ``rows_per_language`` labelled texts of each language, chosen by a hash of
their ids, and keeps every word and n-gram of them. Prediction reads every text whole.

Defined cases: null text or text without a letter is ``und`` with score 0, and so is all when nothing is
labelled; a text with letters of which nothing is known gets the language with most labelled texts, at
an even share; equal sums go to the language first by code point; null labels teach nothing; repeated rows
are predicted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words
from .packing import record

UNKNOWN = "und"
_GRAMS = (5, 4, 3, 2, 1)
#: Bytes of text that a worker looks at together.
_PART = 2 << 20
_PAD = 95  # "_", which is no letter


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of lower-cased letters and spaces, words' starts and ends in them, and where texts' words begin."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column), r"\P{L}+", " ")
    data, at = words.buffer_of(plain)
    return data, *words.word_table(data, at)


def grams(found: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the padded words' n-grams (single characters unpadded), and the words' numbers."""
    code = np.frombuffer(f"_{b'_'.join(found).decode()}_".encode("utf-32-le"), np.uint32)
    pad = code == _PAD
    word = np.cumsum(pad) - 1
    hashed = words.gram_hashes(words.mix(code.astype(np.uint64) + np.uint64(1)), n)
    if n == 1:
        keep = np.flatnonzero(~pad)
    else:
        before = np.concatenate([[0], np.cumsum(pad)])
        at = np.arange(len(hashed))
        keep = np.flatnonzero(before[at + n - 1] == before[at + 1])
    return hashed[keep], word[keep]


@dataclass
class Model:
    languages: list[str]
    prior: int
    keys: list[np.ndarray]  # by n-gram length, words at 0: known hashes, ascending
    logs: list[np.ndarray]  # a row for each, a column for each language

    def _find(self, n: int, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n]
        if not len(keys):
            return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
        spot = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        return spot, keys[spot] == hashed

    def vectors(self, hashed: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies of distinct words by language, and which words have any; ``spell(i)`` gives bytes."""
        spot, known = self._find(0, hashed)
        out = np.zeros((len(hashed), len(self.languages)))
        out[known] = self.logs[0][spot[known]]
        left = np.flatnonzero(~known)
        for n in _GRAMS:
            if not len(left):
                break
            gram, word = grams([spell(i) for i in left.tolist()], n)
            spot, there = self._find(n, gram)
            word, rows = word[there], self.logs[n][spot[there]]
            many = np.bincount(word, minlength=len(left))
            got = many > 0
            for k in range(len(self.languages)):
                out[left[got], k] = (np.bincount(word, weights=rows[:, k], minlength=len(left)) / np.maximum(many, 1))[got]
            known[left[got]] = True
            left = left[~got]
        return out, known

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        data, starts, ends, first = _tokens(column)
        many, texts, width = np.diff(first), len(first) - 1, len(self.languages)
        if not width:
            return [UNKNOWN] * texts, np.zeros(texts)
        raw = data.tobytes()
        hashed, at, inverse = np.unique(words.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        vector, known = self.vectors(hashed, lambda i: raw[starts[at[i]] : ends[at[i]]])
        owner = np.repeat(np.arange(texts), many)
        total = np.stack([np.bincount(owner, weights=vector[inverse, k], minlength=texts) for k in range(width)], -1)
        n = np.bincount(owner, weights=known[inverse], minlength=texts)
        best = np.where(n > 0, total.argmax(axis=1), self.prior)
        gap = np.maximum(total - total[np.arange(texts), best][:, None], -700)
        score = np.where(n > 0, 1 / np.exp(gap * np.minimum(1.0, 50 / np.maximum(n, 1))[:, None]).sum(axis=1), 1 / width)
        return [self.languages[b] if m else UNKNOWN for b, m in zip(best.tolist(), many.tolist())], np.where(many > 0, score, 0.0)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (n = 0) and n-grams by language."""
    for batch in (p for b in batches for p in words.chunks(b)):
        for lang in pc.unique(batch.column("lang")).to_pylist():
            part = batch.filter(pc.equal(batch.column("lang"), lang))
            data, starts, ends, _ = _tokens(part.column("text"))
            raw = data.tobytes()
            hashed, at, times = np.unique(words.word_hashes(data, starts, ends), return_index=True, return_counts=True)
            own = [raw[starts[i] : ends[i]] for i in at.tolist()]
            for n in (0, *_GRAMS):
                keys, weights = (hashed, times) if n == 0 else _summed(*grams(own, n), times)
                many = len(keys)
                yield record(lang=([lang] * many, pa.string()), n=(np.full(many, n), pa.int32()), item=(keys.view(np.int64), pa.int64()), c=(weights, pa.int64()))


def _summed(gram: np.ndarray, word: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(gram, return_inverse=True)
    return keys, np.bincount(inverse, weights=times[word], minlength=len(keys)).astype(np.int64)


def fit(docs: DataFrame, training: Column, *, rows_per_language: int = 1000, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    common.bounded_batches(docs)
    rows = docs.where(training & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], 0, [np.zeros(0, np.uint64)] * 6, [np.zeros((0, 0))] * 6)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / sizes[lang]))])
    place = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(place < F.element_at(share, F.col("lang"))).select("lang", "text").where("text is not null")
    counted = chosen.mapInArrow(_tally, "lang string, n int, item long, c long").groupBy("lang", "n", "item").agg(F.sum("c").alias("c"))
    got = counted.toArrow()
    langs, n, item, c = (got.column(x).to_numpy() for x in ("lang", "n", "item", "c"))
    number = np.searchsorted(languages, langs.astype(str)) if len(langs) else np.zeros(0, np.int64)
    keys, logs = [], []
    for k in range(6):
        mine = n == k
        known, row = np.unique(item[mine].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(known), len(languages)))
        counts[row, number[mine]] = c[mine]
        keys.append(known)
        logs.append(np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * max(1, len(counts)))).astype(np.float32))
    return Model(languages, max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i)), keys, logs)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``id, lang_pred, score`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in words.chunks(batch, limit=_PART)):
            found, score = shared.value.predict(part.column("text"))
            yield record(id=(part.column("id"), pa.int64()), lang_pred=(found, pa.string()), score=(score, pa.float64()))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, *, text: str = "text") -> DataFrame:
    """The documents, as they are, whose language is known with a score of ``least`` or more."""
    shared, shape = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in words.chunks(batch, text, _PART)):
            found, score = shared.value.predict(part.column(text))
            yield part.filter(pa.array([lang != UNKNOWN and x >= least for lang, x in zip(found, score.tolist())], pa.bool_()))

    return docs.mapInArrow(run, shape)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of ``documents``, learned from those whose crc32 mod 4 is not 2."""
    docs = common.table(spark, sf_dir, "documents")
    rows = predict(docs, fit(docs, ~common.held_out("doc_id", 4, 2)))
    return rows.select(F.col("id").alias("doc_id"), common.held_out("id", 4, 2).alias("held_out"), "lang_pred", "score")
