"""Exact vectors of the primitives, claims on reference sentences, negation."""

import math

import pytest
from pyspark.sql import functions as F

from strandline import catalog
from strandline.functions import primitives as P
from strandline.operators import checkers, claims, retrieval, scoring  # noqa: F401

ZERO = [0.0] * 6
VECTORS = [
    ("add_trend", ZERO, dict(start_timestep=1, end_timestep=4, slope=2), [0, 0, 2, 4, 6, 0]),
    ("add_trend", ZERO, dict(start_timestep=1, end_timestep=4, start_offset=1, end_offset=4), [0, 1, 2, 3, 4, 0]),
    ("add_ramp", [0.0] * 5, dict(start_timestep=1, end_timestep=3, start_value=2, end_value=6), [0, 2, 4, 6, 0]),
    ("add_flat", [0.0, 1, 2, 3, 4, 5], dict(start_timestep=2, end_timestep=4, target_value=7.5), [0, 1, 7.5, 7.5, 7.5, 5]),
    ("add_spike", [0.0] * 7, dict(timestep=3, target_value=4), [0, 0, 0, 4, 0, 0, 0]),
    ("add_dip", [10.0] * 5, dict(timestep=4, target_value=5), [10, 10, 10, 10, 5]),
    ("add_outlier", [2.0] * 5, dict(timestep=2, delta=-0.5), [2, 2, 1.5, 2, 2]),
    ("add_level_shift", ZERO, dict(start_timestep=2, shift=3), [0, 0, 3, 3, 3, 3]),
    ("add_change_point", ZERO, dict(anchor_timestep=2, level_change=2, slope_change=1), [0, 0, 2, 3, 4, 5]),
    ("add_seasonality", [0.0] * 8, dict(start_timestep=2, end_timestep=5, amplitude=2, period=4), [0, 0, 0, 2, 0, -2, 0, 0]),
    ("add_volatility", [0.0, 8, 10, 12, 20], dict(start_timestep=1, end_timestep=3, volatility_scale=2, baseline=10), [0, 6, 10, 14, 20]),
    ("add_gap", [0.0, 1, 2, 3, 4, 5], dict(start_timestep=2, end_timestep=4), [0, 1, math.nan, math.nan, math.nan, 5]),
    ("add_plateau", [0.0, 2, 4, 6, 8], dict(start_timestep=1, end_timestep=3, anchor_timestep=4), [0, 8, 8, 8, 8]),
]


@pytest.mark.parametrize(("name", "series", "arguments", "expected"), VECTORS)
def test_primitive(spark, name, series, arguments, expected):
    rows = spark.createDataFrame([([float(x) for x in series],)], "s array<double>")
    got = rows.select(P.BUILDERS[name](F.col("s"), P.named(**arguments)).alias("s")).first()["s"]
    assert got == pytest.approx(expected, abs=1e-7, nan_ok=True)


def test_noise_is_deterministic(spark):
    g = P.named(noise_scale=1.0, random_seed=5)
    rows = spark.createDataFrame([([0.0] * 9,)], "s array<double>").withColumn("z", P.noise_vector(F.col("s"), g))
    one, two = (rows.select(P.add_noise(F.col("s"), g, F.col("z")).alias("s")).first()["s"] for _ in range(2))
    assert one == two and len(set(one)) == 9


CAPTIONS = [
    ([0.0] * 50 + [4 * i / 49 for i in range(50)], "An upward trend; after timestep 50 a shift follows.", lambda r: r["consistency_score"] >= 0.8),
    ([5 * i / 99 for i in range(100)], "A clear downward trend.", lambda r: r["verdict"] == "inconsistent" and r["consistency_score"] <= 0.35),
    ([10 - (i / 25 - 2) ** 2 for i in range(101)], "A peak is observed at timestep 50 with value 10.0.", lambda r: any(c["name"] == "peak_alignment" and c["score"] >= 0.95 for c in r["claims"])),
    ([10 - (i / 25 - 2) ** 2 for i in range(101)], "A peak is observed at timestep 50.", lambda r: any(c["name"] == "peak_alignment" and c["score"] >= 0.95 for c in r["claims"])),
    ([3.0] * 40 + [3.001] * 5 + [3.0] * 55, "Very low volatility with a flat profile.", lambda r: r["verdict"] == "consistent" and all(c["score"] >= 0.9 for c in r["claims"])),
    ([i / 15 for i in range(16)], "An upward trend, and a value 10.0 at timestep 8.", lambda r: r["correctness_score"] < r["consistency_score"] and r["contradicted_rate"] > 0),
    ([16.672, 17.938, 18.501, 19.416, 18, 17, 16, 15.476], "It has a peak of 19.416 at the 4.0 data point, then a decline to 15.476 by the 8.0 data points.", lambda r: {c["name"] for c in r["claims"] if c["score"] >= 0.95} >= {"point_value_3", "point_value_7"}),
    ([0.0, 1, 2, 4, 5, 4.5, 4.2, 4.1], "It stays between 4.0 and 5.0 from the 4.0 to 6.0 data points.", lambda r: any(c["name"] == "range_bounds_3_5" and c["score"] >= 0.95 for c in r["claims"])),
]


@pytest.mark.parametrize(("series", "caption", "holds"), CAPTIONS)
def test_consistency(spark, series, caption, holds):
    rows = spark.createDataFrame([([float(x) for x in series], caption)], "values array<double>, caption string")
    assert holds(claims.evaluate(rows).first())


def test_consistency_rejects_short_series(spark):
    rows = spark.createDataFrame([([1.0, 2.0], "up"), ([1.0] * 7 + [math.nan], "up")], "values array<double>, caption string")
    assert [r["error"] for r in claims.evaluate(rows).collect()] == ["series_too_short", "series_not_finite"]


@pytest.mark.parametrize(("text", "expected"), [("there is no peak", False), ("a peak is seen", True), ("it is not only a peak", False), ("no only peak", True)])
def test_negation(spark, text, expected):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(retrieval.mentioned(F.col("t"), F.lit(r"\bpeak\b")).alias("m")).first()["m"] is expected


def test_checker_with_gap(spark):
    rows = spark.createDataFrame([([1.0, math.nan, math.nan, 4.0],)], "s array<double>")
    got = rows.select(checkers.check_gap(F.col("s"), P.named(start_timestep=1, end_timestep=2)).alias("c")).first()["c"]
    assert got["passed"] and got["error"] == 0.0


def test_equal_values_have_no_spread(spark):
    """The mean of equal values may be off by a rounding, which is no variance."""
    values = [0.1, 29.27, 122.79, 560.21, 1e6 / 3, -7.7]
    rows = spark.createDataFrame([([v] * n,) for v in values for n in (1, 3, 7, 8, 16, 60)] + [([],)], "s array<double>")
    assert {r[0] for r in rows.select(P.stddev(F.col("s"))).collect()} == {0.0}
    got = spark.createDataFrame([([1e9, 1e9 + 1, 1e9 + 3],), ([3.0, -1.0, 4.0, 10.0],), ([1.0, None],), ([1.0, float("nan")],)], "s array<double>").select(P.stddev(F.col("s"))).collect()
    assert got[0][0] == pytest.approx(math.sqrt(14 / 9)) and got[1][0] == pytest.approx(math.sqrt(15.5)) and got[2][0] is None and math.isnan(got[3][0])


def test_checks_as_data_on_repeated_events(spark, tmp_path):
    """Sixty events of one value each: both windows of the variance comparison are level."""
    events = [(i * 100 + k, i, u, v) for u in range(3) for i, v in enumerate([29.27 + u, 122.79, 2.11]) for k in range(60)]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["user_id"], r["check_id"]): r["passed"] for r in catalog.QUERIES["s02_checks_as_data"](spark, str(tmp_path)).collect()}
    assert len(got) == 48 and not any(got[u, c] for u in range(3) for c in ("variance_comparison", "nonconstant_window_1"))


def test_variance_comparison_needs_whole_windows(spark, tmp_path):
    """As in the reference, a window that leaves the series fails the check: 40 points have no place 40."""
    events = [(u * 100 + i, i, u, float(i * i % 37)) for u, n in ((0, 40), (2, 41)) for i in range(n)]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["s02_checks_as_data"](spark, str(tmp_path)).where("check_id = 'variance_comparison'").collect()
    assert {r["user_id"]: r["passed"] for r in got} == {0: False, 2: True}
