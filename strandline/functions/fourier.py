"""The discrete Fourier transform of an array, in n log n steps for every length, as a Column.

A power of two is halved stage by stage (the self-sorting radix-2 scheme: each stage is one ``transform``). Any
length, primes too, becomes a convolution with a chirp (Bluestein), which powers of two can do. Both directions use
the one expression, in a fold of two rounds, since the time to plan a query grows with its expressions. Short arrays
are summed directly, where that is the least work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .primitives import let, mean

#: Up to this length sums over all points are cheaper than the chirp.
DIRECT = 64


def _complex(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def _times(a: Column, b: Column) -> Column:
    return _complex(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def _turn(angle: Column) -> Column:
    return _complex(F.cos(angle), F.sin(angle))


def power_of_two(x: Column) -> Column:
    """The transform of an array of ``struct<re, im>`` whose length is a power of two."""
    size = F.size(x)
    stages = F.sequence(F.lit(0), F.greatest(F.round(F.log2(size)).cast("int") - 1, F.lit(0)))

    def stage(now: Column, s: Column) -> Column:
        m = F.pow(F.lit(2.0), s).cast("int")
        half = (size / 2).cast("int")

        def one(i: Column) -> Column:
            group = F.floor(i / m).cast("int")
            j = F.floor(group / 2).cast("int")
            at = i % m + j * m
            return let(F.struct(F.get(now, at).alias("a"), F.get(now, at + half).alias("b")), lambda c: butterfly(c["a"], c["b"], group, j))

        def butterfly(a: Column, b: Column, group: Column, j: Column) -> Column:
            turned = _times(_complex(a["re"] - b["re"], a["im"] - b["im"]), _turn(-math.pi * j * m / half))
            return F.when(group % 2 == 0, _complex(a["re"] + b["re"], a["im"] + b["im"])).otherwise(turned)

        return F.transform(F.sequence(F.lit(0), size - 1), one)

    return F.when(size <= 1, x).otherwise(F.aggregate(stages, x, stage))


def _chirp(k: Column, n: Column) -> Column:
    """exp(-i pi k^2 / n), by whole numbers as long as it can."""
    return _turn(-math.pi * ((k.cast("long") * k.cast("long")) % (2 * n)) / n)


def transform(x: Column) -> Column:
    """The transform of an array of doubles of any length: an array of ``struct<re, im>``."""
    n = F.size(x)
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(2 * n - 1, F.lit(1))))).cast("int")
    zero = _complex(F.lit(0.0), F.lit(0.0))
    pad = F.array_repeat(zero, F.greatest(width - n, F.lit(0)))
    signal = F.concat(F.transform(x, lambda v, k: let(_chirp(k, n), lambda c: _complex(c["re"] * v, c["im"] * v))), pad)
    place = lambda i: F.when(i < n, i).when(i > width - n, width - i)
    mirror = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(place(i).isNull(), zero).otherwise(let(_chirp(place(i), n), lambda c: _complex(c["re"], -c["im"]))))

    def product(both: Column) -> Column:
        # conjugated, so that transforming it again gives the inverse's conjugate
        return F.zip_with(F.get(both, F.lit(0)), F.get(both, F.lit(1)), lambda a, b: _complex(a["re"] * b["re"] - a["im"] * b["im"], -a["re"] * b["im"] - a["im"] * b["re"]))

    one_round = lambda held, r: let(F.transform(held, power_of_two), lambda done: F.when(r == 0, F.array(product(done))).otherwise(done))
    folded = F.aggregate(F.array(F.lit(0), F.lit(1)), F.array(signal, mirror), one_round, lambda held: F.get(held, F.lit(0)))
    result = F.transform(F.slice(folded, F.lit(1), n), lambda c, k: let(_chirp(k, n), lambda w: _complex((c["re"] * w["re"] + c["im"] * w["im"]) / width, (c["re"] * w["im"] - c["im"] * w["re"]) / width)))
    return F.when(n == 0, F.array().cast("array<struct<re:double,im:double>>")).otherwise(result)


def spectrum(x: Column) -> Column:
    """``(power, minus)`` of each frequency 1 to n/2 of a centered array; ``minus`` is the frequency below zero.

    Powers within a billionth of the strongest count as equal to it, so rounding does not choose between frequencies:
    ``array_max`` gives the first of the strongest.
    """
    n = F.size(x)
    bins = F.sequence(F.lit(1), F.greatest(F.floor(n / 2).cast("int"), F.lit(1)))

    def direct(c: Column, k: Column) -> Column:
        part = lambda f: F.aggregate(F.transform(c, lambda v, i: v * f(2 * math.pi * ((k.cast("long") * i) % n) / n)), F.lit(0.0), lambda a, y: a + y)
        return F.pow(part(F.cos), 2) + F.pow(part(F.sin), 2)

    def powers(c: Column) -> Column:
        by_transform = let(transform(c), lambda t: F.transform(bins, lambda k: F.pow(F.get(t, k)["re"], 2) + F.pow(F.get(t, k)["im"], 2)))
        return F.when(n <= DIRECT, F.transform(bins, lambda k: direct(c, k))).otherwise(by_transform)

    centered = let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    level = lambda p: let(F.array_max(p), lambda top: F.transform(p, lambda v, i: F.struct(F.when(v >= top * (1 - 1e-9), top).otherwise(v).alias("power"), (-(i + 1)).alias("minus"))))
    return let(let(centered, powers), level)
