"""The nearest-series search against all pairs, and how many pairs it opens."""

import math

import numpy as np
from pyspark.sql import functions as F

from strandline.operators.nearest import nearest
from strandline.sources.series import user_series


def all_pairs(series, asked):
    out = {}
    for q in asked:
        x = series.get(q)
        if x is None or any(v is None or math.isnan(v) for v in x):
            continue
        found = []
        for u, y in series.items():
            if u != q and y is not None and x and y and not any(v is None or math.isnan(v) for v in y):
                n = min(len(x), len(y))
                found.append((math.sqrt(sum((a - b) ** 2 for a, b in zip(x[:n], y[:n])) / n), u))
        if found:
            out[q] = min(found)
    return out


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    series = {}
    for u in range(90):
        n = int(rng.integers(0, 70))
        series[u] = [float(v) for v in (rng.exponential(5, n) if u % 2 else np.cumsum(rng.normal(0, 1, n)))]
    series[20], series[21], series[22] = series[19], list(series[19]), None
    series[23], series[24] = [1.0, None, 3.0], [1.0, float("nan")]
    rows = spark.createDataFrame([(u, s, 1.0) for u, s in series.items()], "user_id long, values array<double>, rmse double").repartition(4)
    expected = all_pairs(series, range(90))
    got = nearest(rows, rows, block=20).collect()
    assert {r["q"] for r in got} == set(expected)
    for r in got:
        assert (round(r["rmse"], 9), r["nearest"]) == (round(expected[r["q"]][0], 9), expected[r["q"]][1])
        assert 0 < r["opened"] <= r["pairs"]
    assert nearest(rows.limit(0), rows).count() == 0 == nearest(rows, rows.limit(0)).count()


def test_few_pairs_are_opened(spark):
    series = user_series(spark, "/root/testdata/sf0.1")
    found = nearest(series.where("user_id % 50 = 0"), series).agg(F.sum("opened"), F.sum("pairs")).first()
    assert found[0] < 0.1 * found[1]
    smooth = spark.range(400).select(F.col("id").alias("user_id"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.sin(i / (7.0 + F.col("id"))) * (F.col("id") % 13)).alias("values"))
    found = nearest(smooth.where("user_id % 50 = 0"), smooth).agg(F.sum("opened"), F.sum("pairs")).first()
    assert found[0] < 0.05 * found[1]
