"""Series of any length as rows of bounded size: blocks of consecutive points.

A block is ``key, block, start, n, values``: ``values`` holds the points ``start`` to ``start + size - 1`` of a
series of ``n`` points. No row, group or task grows with the longest series.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Points in a block: 32 KB of doubles.
SIZE = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session may go without; it gets a temporary folder.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns by which null keys meet too; the columns of ``right`` that are no keys are added."""
    renamed = right.select(*(F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*(f"__{k}" for k in keys))


def positions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``t``, each row's place within its key, and ``n``, the rows of the key, by a prefix scan over ranges.

    Rows are dealt into ranges of (key, order), so a key with half of all rows spreads over as many tasks. Each
    range numbers its own rows; the counts of a key's ranges, one row for each, give the places where they begin.
    """
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__row", F.monotonically_increasing_id())
    ranged = cut(ranged.withColumn("__range", F.shiftright("__row", 33)))  # the same ranges for the counts and for the rows
    counts = ranged.groupBy(key, "__range").agg(F.count("*").alias("__count"), F.min("__row").alias("__first"))
    own = Window.partitionBy(key)
    before = F.sum("__count").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "__range", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__count").over(own).alias("n"))
    return joined(ranged, counts, [key, "__range"]).withColumn("t", F.col("__row") - F.col("__first") + F.col("__before")).drop("__row", "__range", "__first", "__before")


def to_blocks(points: DataFrame, key: str, size: int = SIZE, value: str = "value") -> DataFrame:
    """Blocks of rows ``key, t, n, value``."""
    rows = points.select(key, F.floor(F.col("t") / size).cast("long").alias("block"), F.struct("t", F.col(value).cast("double").alias("v")).alias("p"), "n")
    grouped = rows.groupBy(key, "block").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("p")).alias("p"))
    return grouped.select(key, "block", (F.col("block") * size).alias("start"), "n", F.transform("p", lambda p: p["v"]).alias("values"))


def user_blocks(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    """Each user's event values in order of time, in blocks."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    return to_blocks(positions(events, "user_id", "ts", "event_id"), "user_id", size)


def points_of(blocks: DataFrame, *keys: str) -> DataFrame:
    """The long view: ``keys, t, v``."""
    rows = blocks.select(*keys, "start", F.posexplode("values").alias("__i", "v"))
    return rows.select(*keys, (F.col("start") + F.col("__i")).cast("int").alias("t"), "v")


def with_borders(blocks: DataFrame, key: str) -> DataFrame:
    """Adds ``before`` and ``after``, the points on both sides of a block, null at the ends of a series.

    Each block sends one point to either neighbour; the exchange is keyed by block, so no series is one task.
    """
    edge = lambda name, step, place: blocks.select(key, (F.col("block") + step).alias("block"), F.element_at("values", place).alias(name))
    return joined(joined(blocks, edge("before", 1, -1), [key, "block"], "left"), edge("after", -1, 1), [key, "block"], "left")


def running(blocks: DataFrame, key: str) -> DataFrame:
    """Adds ``total``, the sum of all points before a block, and so the base of running sums within it."""
    sums = blocks.select(key, "block", F.aggregate("values", F.lit(0.0), lambda a, v: a + F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0))).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return joined(blocks, sums.select(key, "block", F.coalesce(before, F.lit(0.0)).alias("total")), [key, "block"])
