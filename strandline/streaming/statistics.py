"""Running statistics of each user's series over a stream of events that come late and out of order.

A point's index is its place by time, so a point can be counted for good only once nothing earlier can come. Points
newer than the watermark wait, sorted, in the user's state; what the watermark has passed is folded into eleven
numbers and leaves. State is bounded by the events within the delay, not by the series. Every micro-batch gives the
statistics of all points so far, waiting ones included, so after the last batch they are those of the whole table.

Points that come after later ones were folded are left out and counted as ``late``. The state lives in Spark's
checkpointed state store; the sink is a versioned table whose upserts are named by query and batch. So a restart
neither loses nor repeats a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.versions import VersionedTable

STATE = "n long, total double, squares double, weighted double, low double, low_at long, high double, high_at long, last_ts long, last_id long, late long, ts array<long>, ids array<long>, points array<double>"
RESULT = "user_id long, length int, min double, max double, mean double, std double, slope double, scale double, relative_volatility double, argmax int, argmin int, late long"


@dataclass
class Running:
    """Points folded in order of time: count, sum, squared deviations from the mean, sum of index times value, extremes."""

    n: int = 0
    total: float = 0.0
    squares: float = 0.0
    weighted: float = 0.0
    low: float = float("inf")
    low_at: int = 0
    high: float = float("-inf")
    high_at: int = 0
    last_ts: int = -(1 << 62)
    last_id: int = -(1 << 62)
    late: int = 0

    def fold(self, ts: int, key: int, v: float) -> None:
        if v < self.low:
            self.low, self.low_at = v, self.n
        if v > self.high:
            self.high, self.high_at = v, self.n
        self.weighted += self.n * v
        step = v - self.total / max(self.n, 1)
        self.n += 1
        self.total += v
        self.squares += step * (v - self.total / self.n)
        self.last_ts, self.last_id = ts, key

    def row(self, user: int) -> tuple:
        n, mean = self.n, self.total / self.n
        std = max(self.squares / n, 0.0) ** 0.5
        slope = (self.weighted - (n - 1) / 2 * self.total) / max(n * (n * n - 1) / 12, 1e-12)
        size = max(self.high - self.low, abs(mean), 1.0)
        return user, n, self.low, self.high, mean, std, slope, size, std / size, self.high_at, self.low_at, self.late


def _update(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
    import pandas as pd

    *held, ts, ids, points = state.get if state.exists else (*astuple(Running()), [], [], [])
    folded, waiting = Running(*held), list(zip(ts, ids, points))
    for frame in frames:
        for moment, event, value in zip(frame["at"], frame["event_id"], frame["value"]):
            if (int(moment), int(event)) <= (folded.last_ts, folded.last_id):
                folded.late += 1
            else:
                waiting.append((int(moment), int(event), float(value)))
    waiting.sort()
    final = state.getCurrentWatermarkMs() * 1000
    done = 0
    while done < len(waiting) and waiting[done][0] < final:
        folded.fold(*waiting[done])
        done += 1
    waiting = waiting[done:]
    state.update((*astuple(folded), [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
    now = Running(*astuple(folded))
    for point in waiting:
        now.fold(*point)
    if now.n:
        yield pd.DataFrame([now.row(key[0])], columns=[c.split()[0] for c in RESULT.split(", ")])


def statistics(events: DataFrame, delay: str) -> DataFrame:
    """Statistics of each user that a micro-batch touches; ``events`` is a stream of ``user_id, ts, event_id, value``.

    Rows without user, time or value are left out; a time without zone is read in the session's. ``delay`` is how late an event may be ("2 hours").
    """
    rows = events.where("user_id is not null and ts is not null and value is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select(F.col("user_id").cast("long"), "ts", F.unix_micros("ts").alias("at"), "event_id", F.col("value").cast("double"))
    return rows.groupBy("user_id").applyInPandasWithState(_update, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def run(events: DataFrame, table: VersionedTable, checkpoint: str, delay: str, name: str = "statistics") -> StreamingQuery:
    """Starts the stream over what is there; each batch is one atomic upsert of the table by user."""

    def write(rows: DataFrame, batch: int) -> None:
        table.upsert(rows, ["user_id"], f"{name}-{batch}")
        table.delete_old(keep=3)

    return statistics(events, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
