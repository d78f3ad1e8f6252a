"""Exact medians against sorting, where passes are many and groups are few, heavy or odd."""

import math
import random

import pytest

from strandline.operators.quantiles import medians


def middle(values):
    s = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return None if not s else (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = {
        "uniform": [rng.random() for _ in range(3000)],
        "powers": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(2001)],
        "two": [1.0] * 500 + [2.0] * 500,
        "three": [1.0] * 333 + [2.0] * 334 + [3.0] * 333,
        "nan": [math.nan] * 700 + [1.0, 2.0] * 300,
        "infinite": [math.inf, -math.inf] * 400 + [5.0],
        "none": [None] * 50,
        "one": [4.5, None],
        None: [float(i % 17) for i in range(1000)],
    }
    table = [(k, v, "clash", 1) for k, values in made.items() for v in values]
    rng.shuffle(table)
    return spark.createDataFrame(table, "k string, x double, n string, median int").repartition(5).cache(), made


@pytest.mark.parametrize("few", [20_000, 50, 0])
def test_medians(rows, few):
    table, made = rows
    got = {r["k"]: (r["n"], r["median"]) for r in medians(table, ["k"], "x", few=few, splits=16, accuracy=100).collect()}
    assert set(got) == set(made)
    for k, values in made.items():
        n, m = got[k]
        assert n == sum(v is not None for v in values)
        want = middle(values)
        assert (m is None) == (want is None) and (want is None or m == want or (math.isnan(m) and math.isnan(want))), (k, m, want)


def test_medians_without_keys_and_of_nothing(rows):
    table, made = rows
    assert medians(table.where("k = 'uniform'"), [], "x", few=10, splits=16).collect()[0]["median"] == middle(made["uniform"])
    assert [tuple(r) for r in medians(table.limit(0), [], "x").collect()] == [(0, None)]
    assert medians(table.limit(0), ["k"], "x").count() == 0


def test_samples_send_few_rows(spark):
    """Seeded samples by rank keep at most k rows of a stratum in each task before the shuffle."""
    from strandline import catalog
    from strandline.operators import load

    load()
    for name in ("g06_stratified_sample", "g08_train_valid_split"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")
