"""The 17 series primitives as Column builders over ``ARRAY<DOUBLE>``.

A primitive is ``f(s, g)``: ``s`` a series, ``g(name)`` a parameter as a double column, null where it is
not given. So literal arguments, table columns and plan steps use the same code, and a plan's fold
dispatches by name. Each is pure: it maps an array to an array of the same length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Getter = Callable[[str], Column]
NAN = float("nan")


def named(**arguments) -> Getter:
    """Parameters from Python numbers, strings or columns."""
    return lambda k: (arguments[k] if isinstance(arguments[k], Column) else F.lit(arguments[k])).cast("double") if arguments.get(k) is not None else F.lit(None).cast("double")


def from_map(params: Column) -> Getter:
    """Parameters from a ``MAP<STRING,STRING>``."""
    at = lambda k: F.try_element_at(params, F.lit(k))
    return lambda k: F.when(F.lower(at(k)) == "true", F.lit(1.0)).otherwise(at(k).try_cast("double"))


#: Numeric parameters of primitives and checkers.
KEYS = (
    "slope start_value end_value start_offset end_offset start_timestep end_timestep anchor_timestep timestep target_value growth_rate decay_rate level_change slope_change smooth amplitude width spread half_width "
    "relative_change delta phase baseline period noise_scale random_seed volatility_scale shift fill_value tolerance"
).split()


def typed(params: Column) -> Column:
    """The numeric parameters of a map as one struct, to bind once with ``let`` and read with ``from_struct``."""
    g = from_map(params)
    return F.struct(*[g(k).alias(k) for k in KEYS])


def from_struct(params: Column) -> Getter:
    return lambda k: params[k] if k in KEYS else F.lit(None).cast("double")


def _int(x: Column) -> Column:
    return x.cast("int")


class Length:
    """Stands for a series of which only the length is known, where rules ask for no more."""

    def __init__(self, n: Column):
        self.n = n


def last(s: Column | Length) -> Column:
    return (s.n if isinstance(s, Length) else F.size(s)) - 1


def interval(s: Column, g: Getter, start: str = "start_timestep", end: str = "end_timestep") -> tuple[Column, Column]:
    return _int(F.coalesce(g(start), F.lit(0.0))), _int(F.coalesce(g(end), last(s).cast("double")))


def interval_error(s: Column, g: Getter, start: str = "start_timestep", end: str = "end_timestep") -> Column:
    a, b = interval(s, g, start, end)
    return F.when((a < 0) | (b < 0), "negative_timestep").when((a > last(s)) | (b > last(s)), "timestep_out_of_range").when(b < a, "end_before_start")


def timestep_error(s: Column, t: Column) -> Column:
    return F.when(t.isNull() | (t < 0) | (t > last(s)), "timestep_out_of_range")


def over(s: Column, a: Column, b: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """``f(value, place in the window, index)`` inside [a, b], the series elsewhere."""
    return F.transform(s, lambda v, i: F.when((i >= a) & (i <= b), f(v, i - a, i)).otherwise(v))


def linspace(p: Column, q: Column, length: Column, k: Column) -> Column:
    return F.when(length <= 1, p).when(k == length - 1, q).otherwise(p + k * (q - p) / F.greatest(length - 1, F.lit(1)))


def logistic_step(length: Column, k: Column, steepness: float = 10.0) -> Column:
    """0 to 1 over the window, exactly at both ends."""
    sigmoid = lambda x: 1 / (1 + F.exp(-steepness * x))
    low, high = 1 / (1 + math.exp(steepness)), 1 / (1 + math.exp(-steepness))
    return F.when(length <= 1, F.lit(1.0)).otherwise((sigmoid(linspace(F.lit(-1.0), F.lit(1.0), length, k)) - low) / (high - low))


def amplitude(current: Column, g: Getter) -> Column:
    """The change that reaches a target, or the stated amplitude."""
    return F.coalesce(g("target_value") - current, g("amplitude"))


def add_trend(s: Column, g: Getter) -> Column:
    a, b = interval(s, g)
    first, final = F.coalesce(g("start_value"), g("start_offset")), F.coalesce(g("end_value"), g("end_offset"))
    return over(s, a, b, lambda v, k, i: v + F.coalesce(k * g("slope"), linspace(first, final, b - a + 1, k)))


def add_ramp(s: Column, g: Getter) -> Column:
    a, b = interval(s, g)
    first = F.coalesce(g("start_value"), F.get(s, a))
    final = F.coalesce(g("end_value"), first + g("slope") * (b - a))
    return over(s, a, b, lambda v, k, i: linspace(first, final, b - a + 1, k))


def add_flat(s: Column, g: Getter) -> Column:
    a, b = interval(s, g)
    return over(s, a, b, lambda v, k, i: g("target_value"))


def growth_curve(first: Column, final: Column, rate: Column, length: Column, k: Column) -> Column:
    share = F.when(length <= 1, F.lit(0.0)).otherwise(F.expm1(k * rate / F.greatest(length - 1, F.lit(1))) / F.expm1(rate))
    return first + (final - first) * share


def decay_curve(first: Column, final: Column, rate: Column, length: Column, k: Column) -> Column:
    share = F.when(length <= 1, F.lit(0.0)).otherwise((1 - F.exp(-(k * rate / F.greatest(length - 1, F.lit(1))))) / (1 - F.exp(-rate)))
    return first + (final - first) * share


def _curve(s: Column, g: Getter, rate: str, curve) -> Column:
    a, b = interval(s, g)
    first, final = F.coalesce(g("start_value"), F.get(s, a)), F.coalesce(g("end_value"), F.get(s, b))
    return over(s, a, b, lambda v, k, i: curve(first, final, F.coalesce(g(rate), F.lit(1.0)), b - a + 1, k))


def add_growth(s: Column, g: Getter) -> Column:
    return _curve(s, g, "growth_rate", growth_curve)


def add_decay(s: Column, g: Getter) -> Column:
    return _curve(s, g, "decay_rate", decay_curve)


def add_plateau(s: Column, g: Getter) -> Column:
    a, b = interval(s, g)
    level = F.coalesce(g("target_value"), F.get(s, _int(g("anchor_timestep"))))
    return over(s, a, b, lambda v, k, i: level)


def _tail_weight(g: Getter, length: Column, k: Column) -> Column:
    return F.when(F.coalesce(g("smooth"), F.lit(0.0)) != 0, logistic_step(length, k)).otherwise(F.lit(1.0))


def add_change_point(s: Column, g: Getter) -> Column:
    a, b = interval(s, g, "anchor_timestep")
    level, slope = F.coalesce(g("level_change"), F.lit(0.0)), F.coalesce(g("slope_change"), F.lit(0.0))
    return over(s, a, b, lambda v, k, i: v + _tail_weight(g, b - a + 1, k) * level + k * slope)


def _bump(s: Column, g: Getter, height: Callable[[Column], Column]) -> Column:
    a, b = interval(s, g)
    center = _int(g("timestep"))
    width = F.coalesce(g("width"), g("spread"), F.lit(1.0))
    amp = height(amplitude(F.get(s, center), g))
    return over(s, a, b, lambda v, k, i: v + amp * F.exp(-0.5 * F.pow((i - center) / width, 2)))


def add_peak(s: Column, g: Getter) -> Column:
    return _bump(s, g, lambda a: a)


def add_trough(s: Column, g: Getter) -> Column:
    return _bump(s, g, lambda a: -F.abs(a))


def _impulse(s: Column, g: Getter, height: Callable[[Column], Column]) -> Column:
    center = _int(g("timestep"))
    width = _int(F.greatest(F.coalesce(g("width"), g("half_width"), F.lit(0.0)), F.lit(0.0)))
    amp = height(amplitude(F.get(s, center), g))
    return over(s, center - width, center + width, lambda v, k, i: v + amp * (1 - F.abs(i - center) / (width + 1)))


def add_spike(s: Column, g: Getter) -> Column:
    return _impulse(s, g, lambda a: a)


def add_dip(s: Column, g: Getter) -> Column:
    return _impulse(s, g, lambda a: -F.abs(a))


def add_outlier(s: Column, g: Getter) -> Column:
    at = _int(g("timestep"))
    return over(s, at, at, lambda v, k, i: F.coalesce(g("target_value"), v + F.coalesce(g("relative_change"), g("delta"))))


def wave(kind: Column, angle: Column) -> Column:
    turn = F.pmod(angle, F.lit(2 * math.pi))
    half = turn < math.pi
    return (
        F.when(kind == "cosine", F.cos(angle))
        .when(kind == "square", F.when(half, 1.0).otherwise(-1.0))
        .when(kind == "sawtooth", turn / math.pi - 1)
        .when(kind == "triangle", F.when(half, 2 * turn / math.pi - 1).otherwise(3 - 2 * turn / math.pi))
        .otherwise(F.sin(angle))
    )


def add_seasonality(s: Column, g: Getter, waveform: Column | str = "sine") -> Column:
    a, b = interval(s, g)
    kind = waveform if isinstance(waveform, Column) else F.lit(waveform)
    phase, base = F.coalesce(g("phase"), F.lit(0.0)), F.coalesce(g("baseline"), F.lit(0.0))
    return over(s, a, b, lambda v, k, i: v + base + g("amplitude") * wave(kind, 2 * math.pi * k / g("period") + phase))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unit_normals(seed, length):
    """The generator's first ``length`` normals for a seed; its stream has no counterpart in SQL."""
    import numpy as np
    import pandas as pd

    return pd.Series([np.random.default_rng(int(a)).normal(0.0, 1.0, int(n)).tolist() for a, n in zip(seed, length)])


def noise_vector(s: Column, g: Getter) -> Column:
    """The unit normals of a noise window; a column of its own, since lambdas take no Python function."""
    a, b = interval(s, g)
    return unit_normals(F.coalesce(g("random_seed"), F.lit(7.0)).cast("long"), F.greatest(b - a + 1, F.lit(0)))


def add_noise(s: Column, g: Getter, normals: Column) -> Column:
    a, b = interval(s, g)
    return over(s, a, b, lambda v, k, i: v + g("noise_scale") * F.get(normals, k))


def finite(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, though lambdas inside ``f`` use it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def stddev(values: Column) -> Column:
    """Population standard deviation; the mean is updated value by value, so that equal values give exactly 0."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(a: Column, x: Column) -> Column:
        off, n = x - a["mean"], a["n"] + 1.0
        return F.struct(n.alias("n"), (a["mean"] + off / n).alias("mean"), (a["squares"] + off * (x - (a["mean"] + off / n))).alias("squares"))

    return F.aggregate(values, start, add, lambda a: F.sqrt(a["squares"] / F.greatest(a["n"], F.lit(1.0))))


def window(s: Column, a: Column, b: Column) -> Column:
    return F.slice(s, a + 1, F.greatest(b - a + 1, F.lit(0)))


def add_volatility(s: Column, g: Getter) -> Column:
    a, b = interval(s, g)
    inside = finite(window(s, a, b))
    reference = F.coalesce(g("baseline"), F.when(F.size(inside) > 0, mean(inside)).otherwise(F.lit(0.0)))
    return let(reference, lambda r: over(s, a, b, lambda v, k, i: r + (v - r) * g("volatility_scale")))


def add_level_shift(s: Column, g: Getter) -> Column:
    a = _int(F.coalesce(g("start_timestep"), g("anchor_timestep"), F.lit(0.0)))
    _, b = interval(s, g)
    shift = F.coalesce(g("target_value") - F.get(s, a), g("shift"))
    return over(s, a, b, lambda v, k, i: v + shift * _tail_weight(g, b - a + 1, k))


def add_gap(s: Column, g: Getter) -> Column:
    a, b = interval(s, g)
    return over(s, a, b, lambda v, k, i: F.coalesce(g("fill_value"), F.lit(NAN)))


BUILDERS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (add_trend, add_ramp, add_flat, add_growth, add_decay, add_plateau, add_change_point, add_peak, add_trough, add_spike, add_dip, add_outlier, add_seasonality, add_noise, add_volatility, add_level_shift, add_gap)
}


def value_error(name: Column, s: Column, g: Getter, waveform: Column) -> Column:
    """The first reason for which a primitive would refuse its arguments, or null."""
    events = name.isin("add_peak", "add_trough", "add_spike", "add_dip", "add_outlier")
    bumps = name.isin("add_peak", "add_trough")
    a, b = interval(s, g)
    at = _int(g("timestep"))
    windowed = F.when(name == "add_change_point", interval_error(s, g, "anchor_timestep")).when(
        name == "add_level_shift", F.coalesce(timestep_error(s, _int(F.coalesce(g("start_timestep"), g("anchor_timestep")))), F.when(b < F.coalesce(g("start_timestep"), g("anchor_timestep")), "end_before_start"))
    ).when(~name.isin("add_spike", "add_dip", "add_outlier"), interval_error(s, g))
    return F.coalesce(
        F.when(events, timestep_error(s, at)),
        windowed,
        F.when(bumps & ((at < a) | (at > b)), "window_without_center"),
        F.when(bumps & (F.coalesce(g("width"), g("spread"), F.lit(1.0)) <= 0), "width_not_positive"),
        F.when((name == "add_growth") & (F.coalesce(g("growth_rate"), F.lit(1.0)) <= 0), "rate_not_positive"),
        F.when((name == "add_decay") & (F.coalesce(g("decay_rate"), F.lit(1.0)) <= 0), "rate_not_positive"),
        F.when((name == "add_seasonality") & (g("period") <= 0), "period_not_positive"),
        F.when((name == "add_seasonality") & ~waveform.isin("sine", "cosine", "square", "sawtooth", "triangle"), "unknown_waveform"),
        F.when((name == "add_noise") & (g("noise_scale") < 0), "negative_scale"),
        F.when((name == "add_change_point") & (F.coalesce(g("level_change"), F.lit(0.0)) == 0) & (F.coalesce(g("slope_change"), F.lit(0.0)) == 0), "no_change"),
    )


def apply_step(name: Column, s: Column, g: Getter, waveform: Column, normals: Column) -> Column:
    """The series after a step, dispatched by the primitive's name."""
    out = F.when(F.lit(False), s)
    for n, f in BUILDERS.items():
        extra = (normals,) if n == "add_noise" else (waveform,) if n == "add_seasonality" else ()
        out = out.when(name == n, f(s, g, *extra))
    return out.otherwise(s)


