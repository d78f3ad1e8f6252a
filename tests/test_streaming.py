"""Streamed statistics after shuffled, late and repeated batches, with a restart in between, against the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.claims import scale, slope
from strandline.functions import primitives as P
from strandline.sources.versions import VersionedTable
from strandline.streaming import statistics as S

EVENTS = "user_id long, ts timestamp, event_id long, value double"


def whole(rows):
    s = F.col("values")
    ordered = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r")).select("user_id", F.transform("r", lambda x: x["value"]).alias("values"))
    out = ordered.select("user_id", F.size(s).alias("length"), F.array_min(s).alias("min"), F.array_max(s).alias("max"), P.mean(s).alias("mean"), P.stddev(s).alias("std"), slope(s).alias("slope"), scale(s).alias("scale"), (P.stddev(s) / scale(s)).alias("relative_volatility"), (F.array_position(s, F.array_max(s)) - 1).alias("argmax"), (F.array_position(s, F.array_min(s)) - 1).alias("argmin"))
    return {r["user_id"]: r.asDict() for r in out.collect()}


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i * 60 + rng.randrange(60), i, round(rng.uniform(-5, 5), 3)) for i in range(400)]
    # within an hour events come in any order
    arrived = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 3000))
    made = spark.createDataFrame([(*r[:1], r[1], *r[2:]) for r in arrived], "user_id long, s long, event_id long, value double").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "value").collect()
    table, events = VersionedTable(spark, str(tmp_path / "table")), str(tmp_path / "events")

    def go(part):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(events)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(events)
        S.run(stream, table, str(tmp_path / "checkpoint"), "1 hour").awaitTermination()  # each run takes up the last one's state

    for i in range(0, 400, 80):
        go(made[i : i + 80])
        expected = whole(spark.createDataFrame(made[: i + 80], EVENTS))
        got = {r["user_id"]: r.asDict() for r in table.read().collect()}
        assert set(got) == set(expected)
        for user, row in expected.items():
            assert got[user]["late"] == 0
            assert {k: got[user][k] for k in row} == pytest.approx(row, abs=1e-9)
    # what comes after later points were counted for good is left out, and said to be
    before = {r["user_id"]: r["length"] for r in table.read().collect()}
    go([(2, made[0]["ts"].replace(year=1969), 1000, 99.0), (2, None, 1001, 1.0), (None, made[0]["ts"], 1002, 1.0)])
    after = {r["user_id"]: r.asDict() for r in table.read().collect()}
    assert {u: r["length"] for u, r in after.items()} == before and after[2]["late"] == 1 and after[2]["max"] < 99


def test_waiting_points_are_bounded_by_the_delay():
    class State:
        exists, get = False, None

        def __init__(self):
            self.watermark = 0

        def getCurrentWatermarkMs(self):
            return self.watermark

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    state = State()
    for batch in range(50):
        at = [(batch * 10 + i) * 1_000_000 for i in range(10)]
        state.watermark = max(0, batch * 10_000 - 20_000)
        out = list(S._update((4,), iter([pd.DataFrame({"at": at, "event_id": at, "value": [1.0 * i for i in range(10)]})]), state))
        assert out[0]["length"][0] == 10 * (batch + 1) and len(state.get[-1]) <= 30
