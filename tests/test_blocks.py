"""Series in blocks: places, borders, running sums, and plans that give what they give on whole series."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import blocks as K
from strandline.operators.plan_queries import plan, step
from strandline.plans import execute as X
from strandline.plans import plan as L
from strandline.sources import blocks as B


@pytest.fixture(scope="module")
def events(spark):
    """A key with half of all rows, a null key, null values, and ties in time."""
    rng = random.Random(3)
    rows = [(7 if i % 2 else rng.choice([None, *range(6)]), rng.randrange(500), i, None if i % 97 == 0 else rng.uniform(-5, 5)) for i in range(6000)]
    return spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double").repartition(5).cache()


def whole(events):
    by = {}
    for r in sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"])):
        by.setdefault(r["user_id"], []).append(r["value"])
    return by


def test_blocks_hold_all_points_in_order(spark, events):
    placed = B.positions(events, "user_id", "ts", "event_id")
    blocks = B.cut(B.to_blocks(placed, "user_id", 64))
    expected, got = whole(events), {}
    for r in sorted(blocks.collect(), key=lambda r: r["block"]):
        assert r["start"] == 64 * r["block"] == len(got.get(r["user_id"], [])) and len(r["values"]) <= 64 and r["n"] == len(expected[r["user_id"]])
        got.setdefault(r["user_id"], []).extend(r["values"])
    assert got == expected
    assert B.to_blocks(B.positions(events.limit(0), "user_id", "ts", "event_id"), "user_id").count() == 0


def test_a_long_series_is_no_single_task(spark, events):
    """Half of all rows are one key's; neither the ranges nor the blocks put them into one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = B.positions(events, "user_id", "ts", "event_id")
        blocks = B.cut(B.to_blocks(placed, "user_id", 64))
        tasks = blocks.groupBy(F.spark_partition_id()).agg(F.sum(F.size("values")).alias("n"))
        assert blocks.agg(F.max(F.size("values"))).first()[0] == 64 and tasks.agg(F.max("n")).first()[0] < 6000 * 0.4
        assert "RangePartitioning" not in placed._jdf.queryExecution().executedPlan().toString()  # the ranges are written once
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_borders_and_running_sums(spark, events):
    blocks = B.cut(B.to_blocks(B.positions(events, "user_id", "ts", "event_id"), "user_id", 50))
    expected = whole(events)
    for r in B.running(B.with_borders(blocks, "user_id"), "user_id").collect():
        s, a, b = expected[r["user_id"]], r["start"], r["start"] + len(r["values"])
        assert r["before"] == (s[a - 1] if a else None) and r["after"] == (s[b] if b < len(s) else None)
        assert r["total"] == pytest.approx(sum(v or 0 for v in s[:a]), abs=1e-9)


def random_step(rng, k, n):
    a = rng.randrange(n)
    b = rng.randrange(a, n) if rng.random() < 0.9 else n + 3
    window = {"start_timestep": a, "end_timestep": b} if rng.random() < 0.8 else {}
    at, value = rng.randrange(n), round(rng.uniform(-9, 9), 2)
    choices = {
        "add_flat": {**window, "target_value": value},
        "add_trend": {**window, **rng.choice([{"slope": value / 9}, {"start_value": 1, "end_value": value}])},
        "add_ramp": {**window, **rng.choice([{"end_value": value}, {"slope": 0.5, "start_value": value}])},
        "add_growth": {**window, **rng.choice([{}, {"end_value": value, "growth_rate": 2}])},
        "add_decay": {**window, **rng.choice([{}, {"start_value": value}, {"decay_rate": -1}])},
        "add_plateau": {**window, **rng.choice([{"target_value": value}, {"anchor_timestep": at}])},
        "add_change_point": {"anchor_timestep": a, "end_timestep": b, "level_change": value, "smooth": rng.random() < 0.5},
        "add_peak": {"timestep": at, rng.choice(["amplitude", "target_value"]): value, "width": 2},
        "add_trough": {"timestep": at, rng.choice(["amplitude", "target_value"]): value},
        "add_spike": {"timestep": at, rng.choice(["amplitude", "target_value"]): value, "half_width": rng.randrange(4)},
        "add_dip": {"timestep": at, "amplitude": value, "width": 1},
        "add_outlier": {"timestep": at, rng.choice(["target_value", "delta"]): value},
        "add_seasonality": {**window, "amplitude": 2, "period": 5.5, "phase": 0.3, "waveform": rng.choice(["sine", "square", "triangle", "odd"])},
        "add_noise": {**window, "noise_scale": 0.4, "random_seed": k},
        "add_volatility": {**window, "volatility_scale": 1.5, **rng.choice([{}, {"baseline": 1}])},
        "add_level_shift": {"start_timestep": a, "end_timestep": b, rng.choice(["shift", "target_value"]): value},
        "add_gap": {**window, **rng.choice([{}, {"fill_value": 0}])},
    }
    name = rng.choice(list(choices))
    held = {"kind": rng.choice(["constant_segment", "monotone_window", "point_value"]), "start": 3, "end": rng.randrange(3, 20), "direction": rng.choice(["nondecreasing", "nonincreasing"]), "timestep": rng.randrange(n + 2), "value": value, "tolerance": 4.0}
    return step(name, f"s{k}", extra={"protected_constraints": [held]} if rng.random() < 0.15 else None, **choices[name])


@pytest.mark.parametrize("how", [{}, {"guarded": False}, {"gaps_allowed": False, "protect": False}])
def test_plans_as_on_whole_series(spark, how):
    rng, rows = random.Random(12), []
    for i in range(150):
        n = rng.choice([13, 40, 41])
        base = [step("add_flat", "base", target_value=2, start_timestep=0, end_timestep=n - 1, extra={"semantic_layer": "global_scaffold"})] if rng.random() < 0.7 else []
        rows.append((i, n, plan(*base, *(random_step(rng, k, n) for k in range(rng.randint(1, 5))))))
    plans = spark.createDataFrame(rows, "id long, n int, text string").select("id", "n", F.from_json("text", L.PLAN).alias("plan")).cache()
    order = plans.withColumn("order", L.ordered(F.col("plan.steps"))).withColumn("z", X.noise_of(F.col("order"), F.col("n")))
    expected = {r["id"]: r["x"] for r in order.select("id", X.fold(F.col("order"), F.col("n"), F.col("z"), **how).alias("x")).collect()}
    done = B.cut(K.Engine(size=7, **how).run(plans, "id", F.col("plan.steps")))
    error = {r["id"]: r["error"] for r in K.errors(done, "id").collect()}
    assert error == {i: x["error"] for i, x in expected.items()}
    assert len(set(error.values())) >= 3 or not how.get("guarded", True)
    series = {}
    for r in sorted(done.collect(), key=lambda r: r["block"]):
        series.setdefault(r["id"], []).extend(r["values"])
    for i, x in expected.items():
        if x["error"] is None:
            assert series[i] == pytest.approx(x["values"], abs=1e-9, nan_ok=True)


def test_edits_of_stored_series(spark, events):
    """Steps that read ends, anchors and window means of long stored series."""
    steps = [
        step("add_ramp", "a", start_timestep=10, end_timestep=300, slope=0.1),
        step("add_plateau", "b", start_timestep=301, end_timestep=350, anchor_timestep=305),
        step("add_volatility", "c", start_timestep=100, end_timestep=420, volatility_scale=3),
        step("add_volatility", "d", start_timestep=0, end_timestep=425, volatility_scale=0.5),
        step("add_noise", "e", start_timestep=20, end_timestep=400, noise_scale=2, random_seed=5),
    ]
    stored = B.cut(B.to_blocks(B.positions(events.where("value is not null"), "user_id", "ts", "event_id"), "user_id", 32))
    chosen = F.from_json(F.lit(json.dumps(steps)), f"array<{L.STEP}>")
    done = K.Engine(size=32, guarded=False, listed=True).run(stored.where("block = 0").select("user_id", chosen.alias("steps")), "user_id", F.col("steps"), stored)
    got = {}
    for r in sorted(done.collect(), key=lambda r: r["block"]):
        got.setdefault(r["user_id"], []).extend(r["values"])
    for user, s in whole(events.where("value is not null")).items():
        if len(s) <= 425:
            continue
        s = np.array(s)
        s[10:301] = s[10] + 0.1 * np.arange(291)
        s[301:351] = s[305]
        for a, b, scale in ((100, 420, 3), (0, 425, 0.5)):
            m = s[a : b + 1].mean()
            s[a : b + 1] = m + (s[a : b + 1] - m) * scale
        s[20:401] += 2 * np.random.default_rng(5).normal(0, 1, 381)
        assert got[user] == pytest.approx(s.tolist(), abs=1e-8)
    assert sum(len(v) > 425 for v in got.values()) >= 2


def test_plan_without_steps_or_series(spark):
    plans = spark.createDataFrame([(1, 5, plan()), (2, 0, plan(step("add_flat", target_value=1)))], "id long, n int, text string").select("id", "n", F.from_json("text", L.PLAN).alias("plan"))
    rows = K.Engine(size=4).run(plans, "id", F.col("plan.steps")).collect()
    assert sorted((r["id"], r["block"], r["values"], r["bad"]) for r in rows) == [(1, 0, [0.0] * 4, None), (1, 1, [0.0], None)]
