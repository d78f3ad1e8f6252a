"""As-of and interval joins against plain Python: a hot key, nulls, ties, empty sides, long windows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.operators import joins as J


@pytest.mark.parametrize("exact", [True, False])
def test_asof(spark, exact):
    rng = random.Random(2)
    key = lambda i: 7 if i % 2 else rng.choice([None, 1, 2, 3])
    left = [(i, key(i), rng.choice([None, *range(900)]) if i % 50 == 0 else rng.randrange(900)) for i in range(3000)]
    right = [(i, key(i), None if i % 40 == 0 else rng.randrange(900), rng.random()) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a = spark.createDataFrame(left, "id long, k long, at long").repartition(5)
        b = spark.createDataFrame(right, "rid long, k long, at long, v double").repartition(3)
        got = {r["id"]: (r["rid"], r["v"]) for r in J.asof(a, b, "k", "at", take=("rid", "v"), order=("rid",), exact=exact).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(left)
    for i, k, at in left:
        earlier = [(x, r, v) for r, rk, x, v in right if None not in (k, at, rk, x) and rk == k and (x <= at if exact else x < at)]
        assert got[i] == (max(earlier)[1:] if earlier else (None, None))
    assert J.asof(a, b.limit(0), "k", "at", take=("rid",)).where("rid is not null").count() == 0
    assert J.asof(a.limit(0), b, "k", "at", take=("rid",)).count() == 0


def windows_of(rng, n, high):
    out = []
    for i in range(n):
        a = rng.randrange(-50, high)
        out.append((i, 7 if i % 2 else rng.choice([None, 1, 2]), rng.choice([a, None]) if i % 30 == 0 else a, a + rng.choice([-3, 0, 1, 7, 8, 63, 64, 65, 200, high])))
    return out


@pytest.mark.parametrize("high", [40, 3000])
def test_points_in_windows(spark, high):
    rng = random.Random(high)
    w, p = windows_of(rng, 150, high), [(i, 7 if i % 2 else rng.choice([None, 1, 2]), rng.randrange(-60, high + 50)) for i in range(400)]
    a, b = spark.createDataFrame(w, "id long, k long, a long, b long"), spark.createDataFrame([*p, p[0]], "pid long, k long, t long")
    found = J.points_in(a, b, "k", "a", "b", "t")
    expected = Counter((i, j) for i, k, x, y in w for j, m, t in [*p, p[0]] if k is not None and k == m and x is not None and x <= t <= y)
    assert Counter((r["id"], r["pid"]) for r in found.collect()) == expected
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert J.points_in(a.limit(0), b, "k", "a", "b", "t").count() == 0
    with pytest.raises(ValueError):
        J.points_in(a, b.withColumn("id", F.lit(1)), "k", "a", "b", "t")


def test_overlapping_windows(spark):
    w = windows_of(random.Random(5), 200, 300)
    a = spark.createDataFrame(w, "id long, k long, a long, b long")
    found = J.overlapping(a, a.withColumnsRenamed({"id": "oid", "a": "c", "b": "d"}), "k", "a", "b", "c", "d")
    whole = [(i, k, x, y) for i, k, x, y in w if k is not None and x is not None and x <= y]
    assert Counter((r["id"], r["oid"]) for r in found.collect()) == Counter((i, j) for i, k, x, y in whole for j, m, c, d in whole if k == m and x <= d and c <= y)
