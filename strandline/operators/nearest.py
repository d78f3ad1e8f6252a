"""Nearest series by root mean square error over common timesteps, with bounds that spare most comparisons.

Every series is summarised by the mean and deviation of consecutive segments. Over a segment of w points two series
differ by at least w times the squared differences of these two numbers, so summaries bound the error from below:
first with wide segments, then narrower ones for the pairs that are left. Whole series are compared, best bound
first, only where the bound is under the best error so far.

Asked series go in blocks of ``BLOCK``; each task holds one block and reads its share of all series as a stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 500
#: Points of a segment, from the first bound to the last.
WIDTHS = (16, 4, 2)
_CELLS = 4 << 20

_SCHEMA = "q long, nearest long, rmse double, span double, pairs long, opened long"


def padded(lists: list[np.ndarray], least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.zeros((len(lists), max(least, int(sizes.max(initial=0)))))
    for row, x in zip(out, lists):
        row[: len(x)] = x
    return out, sizes


def summaries(rows: np.ndarray, width: int) -> np.ndarray:
    """Mean and deviation of each whole segment, scaled so that squared differences add up to the bound."""
    parts = rows[:, : rows.shape[1] // width * width].reshape(len(rows), -1, width)
    return np.stack([parts.mean(axis=2), parts.std(axis=2)], axis=2) * math.sqrt(width)


class Search:
    """The nearest series of one block of asked series, among those that are shown to it."""

    def __init__(self, ids: list[int], lists: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.rows, self.sizes = padded(lists)
        self.summaries = [summaries(self.rows, w) for w in WIDTHS]
        self.best, self.nearest = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max)
        self.pairs, self.opened = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def show(self, ids: list[int], lists: list[np.ndarray]) -> None:
        """Compares more series with the asked ones."""
        step = max(1, _CELLS // (len(self.ids) * 2 * max(1, self.rows.shape[1] // WIDTHS[0])))
        for i in range(0, len(ids), step):
            self._show(np.array(ids[i : i + step], np.int64), lists[i : i + step])

    def _show(self, ids: np.ndarray, lists: list[np.ndarray]) -> None:
        # what lies beyond the longest asked series is in no comparison
        rows, sizes = padded([x[: self.rows.shape[1]] for x in lists], self.rows.shape[1])
        known = [summaries(rows, w) for w in WIDTHS]
        shared = np.minimum(self.sizes[:, None], sizes[None, :])
        possible = (self.ids[:, None] != ids[None, :]) & (shared > 0)
        self.pairs += possible.sum(axis=1)
        a, b = np.nonzero(possible)
        bound = np.zeros(len(a))
        for width, asked, shown in zip(WIDTHS, self.summaries, known):
            bound = np.maximum(bound, self._bounds(asked, shown, a, b, shared[a, b], width))
            keep = bound <= self.best[a]
            a, b, bound = a[keep], b[keep], bound[keep]
        order = np.lexsort((bound, a))
        a, b, bound = a[order], b[order], bound[order]
        take = 1
        while len(a):
            # the next few of each asked series, by bound; each round looks at twice as many
            place = np.arange(len(a)) - np.searchsorted(a, a)
            now = place < take
            self._open(rows, sizes, ids, a[now], b[now])
            a, b, bound, take = a[~now], b[~now], bound[~now], take * 2
            keep = bound <= self.best[a]
            a, b, bound = a[keep], b[keep], bound[keep]

    def _bounds(self, asked: np.ndarray, shown: np.ndarray, a: np.ndarray, b: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
        out, segments = np.zeros(len(a)), asked.shape[1]
        step = max(1, _CELLS // max(1, 2 * segments))
        for i in range(0, len(a), step):
            part = slice(i, i + step)
            off = ((asked[a[part]] - shown[b[part]]) ** 2).sum(axis=2)
            whole = np.arange(segments)[None, :] < (shared[part] // width)[:, None]
            # a hair below, so that rounding never drops a pair
            out[part] = np.sqrt(np.where(whole, off, 0.0).sum(axis=1) / shared[part]) * (1 - 1e-9)
        return out

    def _open(self, rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, _CELLS // max(1, rows.shape[1]))
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            shared = np.minimum(self.sizes[x], sizes[y])
            inside = np.arange(rows.shape[1])[None, :] < shared[:, None]
            error = np.sqrt(np.where(inside, (self.rows[x] - rows[y]) ** 2, 0.0).sum(axis=1) / shared)
            self.opened += np.bincount(x, minlength=len(self.ids))
            order = np.lexsort((ids[y], error, x))
            first = order[np.concatenate([[True], np.diff(x[order]) > 0])] if len(order) else order
            for k in first:
                if (error[k], ids[y[k]]) < (self.best[x[k]], self.nearest[x[k]]):
                    self.best[x[k]], self.nearest[x[k]] = error[k], ids[y[k]]


def _whole(values: object) -> np.ndarray | None:
    """The series, or None where a point is missing: it is near to nothing."""
    x = np.array([math.nan if v is None else v for v in values.as_py() or []], float)
    return None if np.isnan(x).any() else x


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task, asked series first."""
    search, task, asked = None, None, ([], [])

    def found() -> pa.RecordBatch:
        any_ = search.pairs > 0
        got = np.isfinite(search.best)
        span = [float(np.ptp(r[:n])) if n else None for r, n in zip(search.rows, search.sizes)]
        columns = [search.ids, pa.array(search.nearest, mask=~got), pa.array(search.best, mask=~got), pa.array(span, pa.float64()), search.pairs, search.opened]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "nearest", "rmse", "span", "pairs", "opened"]).filter(pa.array(any_))

    for batch in batches:
        shown: tuple[list, list] = ([], [])
        for own, kind, key, values in zip(batch["task"].to_pylist(), batch["kind"].to_pylist(), batch["id"].to_pylist(), batch["values"]):
            if own != task:
                if search is not None:
                    search.show(*shown)
                    yield found()
                search, task, asked, shown = None, own, ([], []), ([], [])
            if (x := _whole(values)) is None:
                continue
            if kind == 0:
                asked[0].append(key), asked[1].append(x)
                continue
            if search is None and asked[0]:
                search = Search(*asked)
            shown[0].append(key), shown[1].append(x)
        if search is not None:
            search.show(*shown)
    if search is not None:
        yield found()


def nearest(asked: DataFrame, series: DataFrame, key: str = "user_id", values: str = "values", block: int = BLOCK) -> DataFrame:
    """``q, nearest, rmse, span, pairs, opened`` for each asked series: the nearest other one, the least id among equals.

    ``pairs`` is how many others share timesteps with it, ``opened`` how many of them were compared point by point.
    A series with a missing point is neither asked nor found.
    """
    spark = series.sparkSession
    blocks = max(1, -(-asked.count() // block))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    place = lambda parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    row = lambda df, kind, of_block, of_shard: df.select(of_block.alias("b"), F.col(key).cast("long").alias("id"), F.col(values).alias("values")).withColumn("s", of_shard).select((F.col("b") * shards + F.col("s")).alias("task"), F.lit(kind).alias("kind"), "id", "values")
    one = row(asked, 0, place(blocks), every(shards))
    two = row(series, 1, every(blocks), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    rows = one.unionByName(two).repartition(blocks * shards, "task").sortWithinPartitions("task", "kind")
    found = rows.mapInArrow(_run, _SCHEMA)
    least = F.min(F.when(F.col("rmse").isNotNull(), F.struct("rmse", "nearest")))
    return found.groupBy("q").agg(least.alias("__best"), F.first("span").alias("span"), F.sum("pairs").alias("pairs"), F.sum("opened").alias("opened")).select("q", "__best.nearest", "__best.rmse", "span", "pairs", "opened")
