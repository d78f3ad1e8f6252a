"""The transform against NumPy's, for powers of two, primes and long arrays; the strongest frequency against sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import fourier


def test_transform_of_every_kind_of_length(spark):
    rng = np.random.default_rng(3)
    lengths = [*range(0, 40), 64, 65, 97, 127, 128, 251, 256, 360, 509, 1000, 1021]
    rows = {n: rng.normal(0, 3, n) for n in lengths}
    table = spark.createDataFrame([(n, x.tolist()) for n, x in rows.items()], "n int, x array<double>")
    for r in table.select("n", fourier.transform(F.col("x")).alias("t")).collect():
        got = np.array([c["re"] + 1j * c["im"] for c in r["t"]])
        assert len(got) == r["n"] and np.allclose(got, np.fft.fft(rows[r["n"]]) if r["n"] else [], atol=1e-8 * max(1, r["n"]))


def strongest(x):
    power = np.abs(np.fft.fft(x - x.mean())[1 : max(len(x) // 2, 1) + 1]) ** 2
    return 1 + int(np.flatnonzero(power >= power.max() * (1 - 1e-9))[0])


@pytest.mark.parametrize("lengths", [range(3, 200, 7), [499, 1024, 4999, 10_000]])
def test_first_strongest_frequency(spark, lengths):
    rng, rows = np.random.default_rng(5), []
    for n in lengths:
        t = np.arange(n)
        k = int(rng.integers(1, max(n // 2, 1) + 1))
        rows.append((n, (5 + 2 * np.sin(2 * np.pi * k * t / n + 0.4) + rng.normal(0, 0.3, n))))
    table = spark.createDataFrame([(n, x.tolist()) for n, x in rows], "n int, x array<double>").repartition(4)
    got = {r["n"]: -r["best"]["minus"] for r in table.select("n", F.array_max(fourier.spectrum(F.col("x"))).alias("best")).collect()}
    assert got == {n: strongest(x) for n, x in rows}


def test_ties_go_to_the_first(spark):
    impulse = [1.0] + [0.0] * 99
    table = spark.createDataFrame([(impulse,), ([2.0] * 70,)], "x array<double>")
    got = [r["b"] for r in table.select(F.array_max(fourier.spectrum(F.col("x"))).alias("b")).collect()]
    assert got[0]["minus"] == -1 and got[1]["power"] <= 1e-12
