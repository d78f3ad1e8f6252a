"""Joins on order: the nearest earlier row (as-of), and points in windows or windows that overlap (intervals).

Neither compares all pairs, and a key with half of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.blocks import cut, joined
from ..sources.series import POINTS_SQL, points, rounded, rounded_sql, user_series


def asof(left: DataFrame, right: DataFrame, key: str, at: str, *, right_at: str | None = None, take: Sequence[str] = (), order: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Every row of ``left`` with the columns ``take`` of the last row of ``right`` of its key that is not later.

    Of right rows at one place the last by ``order`` counts. ``exact`` says whether a right row at the very place
    does. Rows without key or place find nothing; taken columns are null where nothing is found.

    Both sides are dealt into ranges of (key, place). Within a range the last right row is carried along; what a
    range takes over from those before it is one row for each range, found by a second pass over these rows alone.
    """
    right_at = right_at or at
    taken = F.struct(*(F.col(c) for c in take), F.lit(True).alias("__hit"))
    tie = F.struct(*(F.col(c) for c in dict.fromkeys([*order, *take])))
    one = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1 if exact else 0).alias("__side"), F.lit(None).cast(right.select(tie.alias("t")).schema["t"].dataType).alias("__tie"), F.struct(*left.columns).alias("__left"))
    two = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).alias("__key"), F.col(right_at).alias("__at"), F.lit(0 if exact else 1).alias("__side"), tie.alias("__tie"), taken.alias("__right"))
    rows = one.unionByName(two, allowMissingColumns=True)
    place = ["__key", "__at", "__side", "__tie"]
    ranged = rows.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("__row", F.monotonically_increasing_id())
    ranged = cut(ranged.withColumn("__range", F.shiftright("__row", 33)))  # the same ranges for both passes
    # of each key in each range the last right row: a key's ranges follow each other
    last = ranged.where("__right is not null").groupBy("__key", "__range").agg(F.max_by("__right", "__row").alias("__right"))
    every = ranged.where("__key is not null").select("__key", "__range").distinct()
    own = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = joined(every, last, ["__key", "__range"], "left").select("__key", "__range", F.last("__right", ignorenulls=True).over(own).alias("__carried"))
    so_far = F.last("__right", ignorenulls=True).over(Window.partitionBy("__range", "__key").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    filled = joined(ranged.withColumn("__so_far", so_far).where("__left is not null"), carried, ["__key", "__range"], "left")
    found = F.when(F.col("__key").isNotNull() & F.col("__at").isNotNull(), F.coalesce("__so_far", "__carried"))
    return filled.withColumn("__found", found).select("__left.*", *(F.col(f"__found.{c}").alias(c) for c in take))


RADIX = 8


def _nodes(start: Column, end: Column, levels: int) -> Column:
    """The fewest aligned stretches of 1, 8, 64, ... places that make up [start, end], as ``(level, node)``."""
    out = []
    for level in range(levels):
        size, wide = RADIX**level, RADIX ** (level + 1)
        low, high = F.ceil(start / F.lit(size)), F.floor((end + 1) / F.lit(size))
        # what whole stretches of the next level cover is left to it
        p, q = F.ceil(start / F.lit(wide)) * RADIX, F.floor((end + 1) / F.lit(wide)) * RADIX
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        kept = run(low, high) if level == levels - 1 else F.when(p < q, F.concat(run(low, p), run(q, high))).otherwise(run(low, high))
        out.append(F.transform(kept, _at_level(level)))
    return F.concat(*out)


def _at_level(level: int):
    return lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))


def points_in(windows: DataFrame, rows: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """Each pair of a window and a point of one key with ``start <= at <= end``: columns of both, but one ``key``.

    A window is cut into aligned stretches, 14 a level at most; a point lies in one stretch of each level. So pairs
    meet in a join on (key, level, stretch), each once and none in vain. Places are whole numbers; windows that are
    empty or lack a bound meet nothing.
    """
    clash = (set(windows.columns) & set(rows.columns)) - {key}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    longest = windows.agg(F.max(b - a)).first()[0]
    levels = 1
    while RADIX**levels <= (longest or 0):
        levels += 1
    cutup = windows.where((a <= b) & F.col(key).isNotNull()).withColumn("__node", F.explode(_nodes(a, b, levels)))
    place = F.col(at).cast("long")
    every = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(place / F.lit(RADIX**k)).alias("node")) for k in range(levels)))
    lying = rows.where(place.isNotNull()).withColumn("__node", F.explode(every))
    return cutup.join(lying, [key, "__node"]).drop("__node")


def overlapping(windows: DataFrame, others: DataFrame, key: str, start: str, end: str, other_start: str, other_end: str) -> DataFrame:
    """Each pair of windows of one key that share a place: one of them begins in the other."""
    first = points_in(windows, others.where(F.col(other_start) <= F.col(other_end)), key, start, end, other_start)
    second = points_in(others, windows.where(F.col(start) <= F.col(end)), key, other_start, other_end, start).where(F.col(start) != F.col(other_start))
    return first.unionByName(second)


# Queries


@query(
    "asof_earlier_anchor",
    """WITH a AS (SELECT user_id, ts, max(value) AS anchor, max(event_id) AS anchor_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, a.anchor_id, a.anchor FROM events e ASOF LEFT JOIN a ON e.user_id = a.user_id AND e.ts > a.ts""",
)
def earlier_anchor(spark, sf_dir):
    """For each event the user's last purchase before it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value", "event_type")
    anchors = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("anchor"), F.max("event_id").alias("anchor_id"))
    return asof(events.select("event_id", "user_id", "ts"), anchors, "user_id", "ts", take=("anchor_id", "anchor"), exact=False).select("event_id", "user_id", "anchor_id", "anchor")


_WINDOWS_SQL = f"{POINTS_SQL}, w AS (SELECT user_id, t AS a, t + floor(v)::BIGINT % 23 AS b FROM p WHERE t % 3 = 0)"


def _windows(rows: DataFrame, step: int) -> DataFrame:
    """At every third timestep a window as long as the value there says."""
    return rows.where(F.col("t") % step == 0).select("user_id", F.col("t").cast("long").alias("a"), (F.col("t") + F.floor("v") % 23).cast("long").alias("b"))


@query("interval_points_in_windows", f"WITH {_WINDOWS_SQL} SELECT w.user_id, a, b, count(*) AS points, {rounded_sql('sum(v)')} AS total, {rounded_sql('max(v)')} AS highest FROM w JOIN p ON p.user_id = w.user_id AND t BETWEEN a AND b GROUP BY w.user_id, a, b")
def points_in_windows(spark, sf_dir):
    """Windows against timesteps: count, sum and maximum of the points in each."""
    rows = points(user_series(spark, sf_dir), "user_id")
    return points_in(_windows(rows, 3), rows, "user_id", "a", "b", "t").groupBy("user_id", "a", "b").agg(F.count("*").alias("points"), rounded(F.sum("v")).alias("total"), rounded(F.max("v")).alias("highest"))


@query("interval_overlapping_windows", f"WITH {_WINDOWS_SQL} SELECT x.user_id, x.a, x.b, count(*) - 1 AS others FROM w x JOIN w y ON x.user_id = y.user_id AND x.a <= y.b AND y.a <= x.b GROUP BY x.user_id, x.a, x.b")
def overlapping_windows(spark, sf_dir):
    """How many other windows of the user each window overlaps."""
    own = _windows(points(user_series(spark, sf_dir), "user_id"), 3)
    pairs = overlapping(own, own.withColumnsRenamed({"a": "c", "b": "d"}), "user_id", "a", "b", "c", "d")
    return pairs.groupBy("user_id", "a", "b").agg((F.count("*") - 1).alias("others"))
