"""Document quality by Bradley-Terry pairwise ranking (operator 3).

Each pair of a preferred and a rejected labelled document says that one has the higher score. Scores are
linear in text features; weights minimise the logistic loss of feature differences over all pairs (with a
small ridge). The threshold is the quantile of training scores at the share of rejected documents, and
maps to 0.7: ``score = sigmoid(s - threshold + log(0.7 / 0.3))``.

Features come from the text alone: shares of character classes, word and line statistics, and hashed byte
trigrams. Every labelled training document is read whole and takes part in all its pairs, in the features'
means and deviations and in the threshold; scoring reads every text whole.

Defined cases: null text counts as empty, and empty texts are scored like others; null labels teach nothing;
a document with several labels teaches each; without labels of both classes all scores are 0.7;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words
from .packing import record, unzip_bytes, zip_bytes

TRIGRAMS = 1024
#: Features of a text.
WIDTH = 23 + TRIGRAMS
#: Scores of training rows are counted at steps of this width; between steps losses are interpolated.
STEP = 1 / 32
_LOGIT = float(np.log(0.7 / 0.3))


def _class_of() -> np.ndarray:
    kind = np.full(256, 7)  # control
    for k, group in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 13), (44, 46), range(128, 256))):
        kind[list(group)] = k
    rest = [b for b in range(33, 127) if kind[b] == 7]
    kind[rest] = 8
    return kind


_CLASS = _class_of()


def features(part: pa.RecordBatch, text: str = "text") -> np.ndarray:
    """A row of features for each text."""
    data, at = words.buffer_of(part.column(text))
    n, size = part.num_rows, np.diff(at)
    owner = np.repeat(np.arange(n), size)
    share = lambda total, of: np.divide(total, of, out=np.zeros(n), where=of > 0)
    classes = np.bincount(owner * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
    starts, ends, first = words.word_table(data, at)
    many, length, word_owner = np.diff(first), ends - starts, np.repeat(np.arange(n), np.diff(first))
    hashed = words.word_hashes(data, starts, ends)
    order = np.lexsort((hashed, word_owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (word_owner[order][1:] != word_owner[order][:-1])
    distinct = np.bincount(word_owner[order][fresh], minlength=n)
    echo = np.zeros(len(hashed), bool)
    echo[1:] = (hashed[1:] == hashed[:-1]) & (word_owner[1:] == word_owner[:-1])
    last, begin = (_CLASS[data[ends - 1]], _CLASS[data[starts]]) if len(starts) else (starts, starts)
    lines = np.bincount(owner[data == 10], minlength=n)
    same = np.zeros(n)
    for i in np.flatnonzero(lines > 0).tolist():
        own = data[at[i] : at[i + 1]].tobytes().split(b"\n")
        same[i] = 1 - len(set(own)) / len(own)
    columns = [
        *(share(classes[:, k], size) for k in range(9)), np.log1p(size), np.log1p(many), share(distinct, many), same, share(lines, many),
        share(np.bincount(word_owner[echo], minlength=n), many), share(np.bincount(word_owner, weights=length, minlength=n), many), share(np.bincount(word_owner[length > 20], minlength=n), many),
        *(share(np.bincount(word_owner[last == k], minlength=n), many) for k in (2, 5, 8)), *(share(np.bincount(word_owner[begin == k], minlength=n), many) for k in (1, 2, 8)),
    ]
    grams = np.zeros((n, TRIGRAMS), np.float32)
    if len(data) > 2:
        code = data.astype(np.uint32)
        code = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)
        inside = owner[:-2] == owner[2:]
        grams = np.bincount((owner[:-2] * TRIGRAMS + code)[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        grams = np.sqrt(grams / np.maximum(1, grams.sum(axis=1, keepdims=True)))
    return np.hstack([np.stack(columns, axis=1), grams]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + _LOGIT, -500, 500)))


def _labelled(docs: DataFrame, known: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows ``x, preferred`` of packed features of the labelled documents, some thousand documents each."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(known.hint("merge"), "id").select("label", "text")  # labels grow with the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch):
                preferred = part.column("label").to_numpy() == 1
                yield record(x=([zip_bytes(features(part).tobytes())], pa.binary()), preferred=([preferred.tobytes()], pa.binary()))

    return common.cut(rows.mapInArrow(run, "x binary, preferred binary"))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, preferred in zip(batch.column("x"), batch.column("preferred")):
            kind = np.frombuffer(preferred.as_py(), bool)
            yield np.frombuffer(unzip_bytes(x.as_py()), np.float32).reshape(len(kind), -1), kind
            words.release()


def _sums(blocks: DataFrame, work: Callable[[np.ndarray, np.ndarray], dict[int, float]]) -> dict[int, float]:
    """What ``work(x, preferred)`` gives for each place, summed over all blocks in one order whatever the schedule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, float] = {}
        for x, preferred in _opened(batches):
            for place, amount in work(x, preferred).items():
                total[place] = total.get(place, 0.0) + amount
        yield record(place=(list(total), pa.int64()), amount=(list(total.values()), pa.float64()))

    parts = blocks.mapInArrow(run, "place long, amount double").groupBy("place").agg(F.array_sort(F.collect_list("amount")).alias("amounts"))
    got = parts.select("place", F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x).alias("amount")).toArrow()
    return dict(zip(got.column("place").to_pylist(), got.column("amount").to_pylist()))


def _vector(sums: dict[int, float], size: int) -> np.ndarray:
    return np.array([sums.get(k, 0.0) for k in range(size)])


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = (x - mean.astype(np.float32)) / scale.astype(np.float32)
    return np.clip(z, -8, 8, out=z)


def _steps(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step below each score, and how far the score is on the way to the next."""
    at = np.floor(raw / STEP)
    return at.astype(np.int64), raw / STEP - at


def _counts(raw: np.ndarray, preferred: np.ndarray) -> dict[int, float]:
    """Scores shared between their two nearest steps; odd places count the preferred."""
    at, over = _steps(raw)
    place, share = np.concatenate([at, at + 1]) * 2 + np.tile(preferred, 2), np.concatenate([1 - over, over])
    found, inverse = np.unique(place, return_inverse=True)
    return dict(zip(found.tolist(), np.bincount(inverse, weights=share).tolist()))


@dataclass
class Pairs:
    """All pairs of a preferred and a rejected score, from counts by steps: mean loss, and its slope at every step."""

    loss: float
    first: int
    slopes: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, float]) -> Pairs:
        place = np.array(sorted(counts))
        first, last = int(place[0]) >> 1, int(place[-1]) >> 1
        amount = np.zeros((2, last - first + 1))
        amount[place & 1, (place >> 1) - first] = [counts[k] for k in place.tolist()]
        amount /= amount.sum(axis=1, keepdims=True)
        n = amount.shape[1]
        gap = np.arange(1 - n, n) * STEP
        size = 1 << (3 * n).bit_length()
        over = lambda a, f: np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(f, size), size)[n - 1 : 2 * n - 1]
        # a rejected score s loses softplus(s - t) against each preferred t; a preferred t the same against each s
        loss = float(amount[0] @ over(amount[1], np.logaddexp(0, gap)))
        return cls(loss, first, np.stack([over(amount[1], 1 / (1 + np.exp(-gap))), -over(amount[0], 1 / (1 + np.exp(gap)))]))

    def slope(self, raw: np.ndarray, preferred: np.ndarray) -> np.ndarray:
        at, over = _steps(raw)
        at, kind = at - self.first, preferred.astype(np.int64)
        return self.slopes[kind, at] * (1 - over) + self.slopes[kind, np.minimum(at + 1, self.slopes.shape[1] - 1)] * over


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Limited-memory quasi-Newton direction from past changes of weights and gradients."""
    d, alphas = -gradient, []
    for s, y in reversed(past):
        alphas.append((s @ d) / (s @ y))
        d = d - alphas[-1] * y
    if past:
        s, y = past[-1]
        d = d * ((s @ y) / (y @ y))
    for (s, y), alpha in zip(past, reversed(alphas)):
        d = d + (alpha - (y @ d) / (s @ y)) * s
    return d


def fit_pairs(blocks: DataFrame, *, ridge: float = 0.02, steps: int = 25, tolerance: float = 2e-3) -> Model | None:
    """Minimises the mean logistic loss over every pair of a preferred and a rejected row of ``blocks``.

    A pass counts the scores of each class by steps, which gives the loss of all pairs and its slope at any
    score; a second pass sums the gradient. None where a class is missing.
    """
    width = WIDTH
    total = _sums(blocks, lambda x, p: dict(enumerate(x.sum(axis=0, dtype=np.float64).tolist())) | {width: float(p.sum()), width + 1: float((~p).sum())})
    good, bad = int(total.get(width, 0)), int(total.get(width + 1, 0))
    if not good or not bad:
        return None
    mean = _vector(total, width) / (good + bad)
    squares = _sums(blocks, lambda x, p: dict(enumerate(((x - mean) ** 2).sum(axis=0).tolist())))
    scale = np.maximum(np.sqrt(_vector(squares, width) / (good + bad)), 1e-6)

    def measure(w: np.ndarray) -> tuple[float, Pairs]:
        v = w.astype(np.float32)
        pairs = Pairs.of(_sums(blocks, lambda x, p: _counts((_standard(x, mean, scale) @ v).astype(np.float64), p)))
        return pairs.loss + ridge / 2 * float(w @ w), pairs

    def gradient(w: np.ndarray, pairs: Pairs) -> np.ndarray:
        v = w.astype(np.float32)

        def work(x: np.ndarray, p: np.ndarray) -> dict[int, float]:
            z = _standard(x, mean, scale)
            slope = pairs.slope((z @ v).astype(np.float64), p) / np.where(p, good, bad)
            return dict(enumerate((slope @ z).tolist()))

        return ridge * w + _vector(_sums(blocks, work), width)

    w, past = np.zeros(width), []
    loss, pairs = measure(w)
    g = gradient(w, pairs)
    for _ in range(steps):
        d = _direction(g, past)
        size = 1.0 if past else min(1.0, 1 / float(np.abs(g).sum()))
        while (to := measure(w + size * d))[0] > loss + 1e-4 * size * float(g @ d) and size > 1e-3:
            size /= 2
        if to[0] >= loss:
            break
        new = gradient(w + size * d, to[1])
        if (size * d) @ (new - g) > 1e-12:
            past = [*past, (size * d, new - g)][-10:]
        w, loss, g = w + size * d, to[0], new
        if np.linalg.norm(g) < tolerance:
            break
    model = Model(mean, scale, w, 0.0)
    model.threshold = _threshold(blocks, model, bad)
    return model


def _threshold(blocks: DataFrame, model: Model, bad: int) -> float:
    """The middle between the training scores of rank ``bad`` and the next, counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _opened(batches):
            bits = model.raw(x).view(np.int64)
            yield record(place=(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), pa.int64()))  # in the order of the scores

    places = common.cut(blocks.mapInArrow(run, "place long"))

    def at_rank(rank: int) -> float:
        left = places
        for bits in (48, 32, 16, 0):
            sizes = left.groupBy(F.shiftright("place", bits).alias("top")).count().toArrow().sort_by("top")
            top, upto = sizes.column("top").to_numpy(), np.cumsum(sizes.column("count").to_numpy())
            k = int(np.searchsorted(upto, rank, "right"))
            rank -= int(upto[k - 1]) if k else 0
            left = left.where(F.shiftright("place", bits) == int(top[k]))
        place = top[k : k + 1]
        return float(np.where(place < 0, place ^ np.int64(2**63 - 1), place).view(np.float64)[0])

    return (at_rank(bad - 1) + at_rank(bad)) / 2


def fit(docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """The model, or None where labels of one class are missing. ``training`` is asked of the labels."""
    common.bounded_batches(docs)
    known = labels.where(training & F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    return fit_pairs(_labelled(docs, known, id_col, text))


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``id, score`` for every row of ``docs``."""
    common.bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in words.chunks(batch):
                yield record(id=(part.column("id"), pa.int64()), score=(m.scores(features(part)) if m else np.full(part.num_rows, 0.7), pa.float64()))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def op3_quality_rank(spark, sf_dir: str) -> DataFrame:
    """Quality of ``documents``, learned from labels of those whose crc32 mod 4 is not 2."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    rows = score(docs, fit(docs, labels, ~common.held_out("doc_id", 4, 2)))
    return rows.select(F.col("id").alias("doc_id"), common.held_out("id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
