"""Queries of the streaming operators over the test tables, replayed as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import ORACLE_SQL, query
from ..sources import series as R
from ..sources.blocks import shared_folder
from ..sources.versions import VersionedTable
from ..streaming import statistics


@query("c13_streaming_statistics", ORACLE_SQL["c13_series_statistics"])
def c13_streaming(spark, sf_dir):
    """The statistics of each user's series after the stream of all events has been read."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may name one file, a plain path only a folder
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = VersionedTable(spark, f"{folder}/table")
    statistics.run(events, table, f"{folder}/checkpoint", "1 hour").awaitTermination()
    rounded = ("min", "max", "mean", "std", "slope", "scale", "relative_volatility")
    return table.read().select("user_id", "length", *(R.rounded(F.col(c)).alias(c) for c in rounded), "argmax", "argmin")
