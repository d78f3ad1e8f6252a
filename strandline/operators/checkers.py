"""Feature checkers: does a series segment show a feature? One struct (passed, score, error) for each.

A segment is a window of the series with what may be NaN (gaps); a checker that cannot evaluate has
infinite error and fails. All are expressions over one row's array.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import primitives as P
from ..functions.fourier import spectrum
from ..functions.primitives import Getter
from ..sources.series import SERIES_SQL, rounded, rounded_sql, user_series

INFINITE = float("inf")


def result(passed: Column, score: Column, error: Column) -> Column:
    return F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), F.coalesce(score, F.lit(0.0)).cast("double").alias("score"), F.coalesce(error, F.lit(INFINITE)).cast("double").alias("error"))


def graded(error: Column, tolerance: Column) -> Column:
    """Passed within tolerance; the score falls with the error and is 0 where it is not finite."""
    e = F.when(F.isnan(error), F.lit(INFINITE)).otherwise(F.coalesce(error, F.lit(INFINITE)))
    score = F.when(e == INFINITE, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - e / F.greatest(tolerance, F.lit(1e-12)))))
    return result(e <= tolerance, score, e)


def yes_no(passed: Column, error: Column) -> Column:
    return result(passed, F.when(passed, 1.0).otherwise(0.0), F.when(passed, 0.0).otherwise(error))


def cannot() -> Column:
    return result(F.lit(False), F.lit(0.0), F.lit(INFINITE))


def tol(g: Getter) -> Column:
    return F.coalesce(g("tolerance"), F.lit(1e-6))


def _differences(x: Column) -> Column:
    n = F.size(x)
    return F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def _max_abs(x: Column) -> Column:
    return F.array_max(P.finite(F.transform(x, lambda v: F.abs(v))))


def _whole(x: Column) -> Column:
    return F.size(P.finite(x)) == F.size(x)


def _ends(x: Column) -> tuple[Column, Column]:
    return F.get(x, F.lit(0)), F.get(x, F.size(x) - 1)


def segment(s: Column, g: Getter) -> Column:
    a, b = P.interval(s, g)
    return P.window(s, a, b)


def window_error(s: Column, g: Getter) -> Column:
    return P.interval_error(s, g)


def check_flat(s: Column, g: Getter) -> Column:
    x = segment(s, g)
    spread, t = P.stddev(P.finite(x)), g("target_value")
    stated = graded(F.greatest(_max_abs(F.transform(x, lambda v: v - t)), spread), tol(g))
    return F.when(F.size(P.finite(x)) == 0, cannot()).when(t.isNull(), graded(spread, F.greatest(tol(g), F.lit(1e-6)))).otherwise(stated)


def check_ramp(s: Column, g: Getter) -> Column:
    x = segment(s, g)
    first, final = _ends(x)
    line = F.transform(x, lambda v, i: v - P.linspace(g("start_value"), g("end_value"), F.size(x), i))
    d = _differences(x)
    monotone = F.least(F.greatest(F.lit(0.0), -F.array_min(d)), F.greatest(F.lit(0.0), F.array_max(d)))
    change = F.abs(final - first)
    tolerance = F.greatest(tol(g), F.lit(1e-6), 0.02 * F.greatest(change, F.lit(1.0)))
    error = F.greatest(monotone, P.stddev(d), F.when(change <= tolerance, tolerance).otherwise(F.lit(0.0)))
    return F.when((F.size(x) < 2) | ~_whole(x), cannot()).when(g("start_value").isNotNull() & g("end_value").isNotNull(), graded(_max_abs(line), tol(g))).otherwise(graded(error, tolerance))


def _curve(s: Column, g: Getter, rate: str, curve: Callable, down: bool) -> Column:
    x = segment(s, g)
    first, final = _ends(x)
    d = _differences(x)
    violation = F.greatest(F.lit(0.0), F.array_max(d) if down else -F.array_min(d))
    expected = _max_abs(F.transform(x, lambda v, i: v - curve(g("start_value"), g("end_value"), g(rate), F.size(x), i)))
    error = F.greatest(violation, F.abs(first - g("start_value")), F.abs(final - g("end_value")), F.when(g(rate) > 0, expected))
    return F.when((F.size(x) < 2) | ~_whole(x) | (g(rate) <= 0), cannot()).otherwise(graded(error, F.greatest(tol(g), F.lit(1e-6))))


def check_growth(s: Column, g: Getter) -> Column:
    return _curve(s, g, "growth_rate", P.growth_curve, False)


def check_decay(s: Column, g: Getter) -> Column:
    return _curve(s, g, "decay_rate", P.decay_curve, True)


def check_trend(s: Column, g: Getter) -> Column:
    x = segment(s, g)
    first, _ = _ends(x)
    error = _max_abs(F.transform(x, lambda v, i: v - first - i * g("slope")))
    return F.when((F.size(x) < 2) | g("slope").isNull(), cannot()).otherwise(graded(error, F.greatest(tol(g), F.abs(g("slope")) * 0.05 + 1e-6)))


def _center(g: Getter) -> Column:
    return F.coalesce(g("timestep"), g("start_timestep"), F.lit(-1.0)).cast("int")


def _neighbours(s: Column, t: Column) -> Column:
    return P.finite(F.array(F.when(t > 0, F.get(s, F.greatest(t - 1, F.lit(0)))), F.get(s, t + 1)))


def prominence_tolerance(s: Column, t: Column) -> Column:
    near = F.concat(_neighbours(s, t), P.finite(F.array(F.get(s, t))))
    return F.greatest(F.lit(1e-6), 1e-4 * F.greatest(F.lit(1.0), _max_abs(near)))


def local_extreme(s: Column, g: Getter, high: bool) -> Column:
    """The center is the window's (or its neighbours') extreme, and stands out of the next value."""
    t = _center(g)
    center = F.get(s, t)
    sign = 1.0 if high else -1.0
    x = F.transform(P.finite(segment(s, g)), lambda v: v * sign)
    top = F.array_max(x)
    next_value = F.coalesce(P.let(top, lambda highest: F.array_max(F.filter(x, lambda v: v < highest))), center * sign)
    near = F.transform(_neighbours(s, t), lambda v: v * sign)
    windowed = g("end_timestep").isNotNull() & (g("end_timestep") > g("start_timestep"))
    reference = F.when(windowed, next_value).otherwise(F.array_max(near))
    extreme = F.when(windowed, center * sign >= top - 1e-8).otherwise(center * sign > F.array_max(near))
    tolerance = prominence_tolerance(s, t)
    passed = extreme & (center * sign - reference > tolerance)
    impossible = center.isNull() | F.isnan(center) | F.when(windowed, F.size(x) < 2).otherwise(F.size(near) == 0)
    return F.when(impossible, cannot()).otherwise(yes_no(passed, F.greatest(F.lit(0.0), tolerance - (center * sign - reference))))


def _before(s: Column, t: Column) -> Column:
    return F.when(t > 0, F.get(s, F.greatest(t - 1, F.lit(0)))).otherwise(0.0)


def _event(s: Column, g: Getter, otherwise: Column) -> Column:
    t = _center(g)
    outside = (t < 0) | (t >= F.size(s))
    return F.when(outside, cannot()).when(g("target_value").isNotNull(), graded(F.abs(F.get(s, t) - g("target_value")), tol(g))).otherwise(otherwise)


def check_spike(s: Column, g: Getter) -> Column:
    t = _center(g)
    sized = graded(F.abs(F.get(s, t) - _before(s, t) - g("amplitude")), tol(g))
    return _event(s, g, F.when(g("amplitude").isNotNull(), sized).otherwise(local_extreme(s, g, True)))


def check_dip(s: Column, g: Getter) -> Column:
    t = _center(g)
    sized = graded(F.abs(_before(s, t) - F.get(s, t) - F.abs(g("amplitude"))), tol(g))
    return _event(s, g, F.when(g("amplitude").isNotNull(), sized).otherwise(local_extreme(s, g, False)))


def check_peak(s: Column, g: Getter) -> Column:
    return _event(s, g, local_extreme(s, g, True))


def check_trough(s: Column, g: Getter) -> Column:
    return _event(s, g, local_extreme(s, g, False))


def check_outlier(s: Column, g: Getter) -> Column:
    t = _center(g)
    near, change = _neighbours(s, t), F.coalesce(g("delta"), g("relative_change"))
    stands_out, tolerance = F.abs(F.get(s, t) - P.mean(near)), prominence_tolerance(s, t)
    free = F.when(F.size(near) == 0, cannot()).otherwise(yes_no(stands_out > tolerance, tolerance - stands_out))
    return _event(s, g, F.when(change.isNotNull(), graded(F.abs(F.get(s, t) - _before(s, t) - change), tol(g))).otherwise(free))


def check_level_shift(s: Column, g: Getter) -> Column:
    a, _ = P.interval(s, g)
    x = segment(s, g)
    before, level = _before(s, a), P.mean(x)
    stated = F.coalesce(g("target_value"), before + g("shift"))
    shift = F.abs(level - before)
    tolerance = F.greatest(tol(g), F.lit(1e-6), 1e-4 * F.greatest(F.lit(1.0), F.abs(before), F.abs(level)))
    free = F.when((F.size(x) == 0) | ~_whole(x), cannot()).otherwise(yes_no(shift > tolerance, tolerance - shift))
    return F.when(stated.isNotNull(), graded(_max_abs(F.transform(x, lambda v: v - stated)), tol(g))).otherwise(free)


def check_change_point(s: Column, g: Getter) -> Column:
    a, b = P.interval(s, g)
    x = segment(s, g)
    first, final = _ends(x)
    level = F.abs(F.get(s, a) - _before(s, a) - g("level_change"))
    bend = F.abs((final - first) / F.greatest(F.size(x) - 1, F.lit(1)) - g("slope_change"))
    return F.when(g("level_change").isNotNull(), graded(level, tol(g))).when(g("slope_change").isNotNull(), graded(bend, tol(g))).otherwise(cannot())


def check_seasonality(s: Column, g: Getter) -> Column:
    x = segment(s, g)
    amplitude = F.abs(g("amplitude"))
    amp_error = F.abs((F.array_max(P.finite(x)) - F.array_min(P.finite(x))) / 2.0 - amplitude)
    amp_tol = F.greatest(tol(g), 0.2 * F.greatest(amplitude, F.lit(1e-6)))
    best = F.array_max(spectrum(x))
    period = F.size(x) / F.greatest(-best["minus"], F.lit(1))
    period_error = F.abs(period - g("period")) / F.greatest(g("period"), F.lit(1.0))
    error = F.greatest(amp_error / F.greatest(amp_tol, F.lit(1e-12)), period_error)
    passed = (amp_error <= amp_tol) & (period_error <= 0.25)
    timed = result(passed, F.when(passed, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(error, F.lit(1.0)))), error)
    return F.when((F.size(x) < 3) | amplitude.isNull(), cannot()).when(g("period").isNull(), graded(amp_error, amp_tol)).when(~_whole(x) | (best["power"] <= 1e-12), cannot()).otherwise(timed)


def check_noise(s: Column, g: Getter) -> Column:
    x = segment(s, g)
    spread = P.stddev(x)
    least = F.greatest(F.lit(1e-8), 0.05 * F.greatest(g("noise_scale"), F.lit(1e-8)))
    stated = yes_no(spread >= least, least - spread)
    return F.when((F.size(x) < 2) | ~_whole(x), cannot()).when(g("noise_scale").isNull(), yes_no(spread > 1e-8, F.lit(1.0))).otherwise(stated)


def check_volatility(s: Column, g: Getter) -> Column:
    return F.when(_whole(segment(s, g)), result(F.lit(True), F.lit(1.0), F.lit(0.0))).otherwise(cannot())


def check_gap(s: Column, g: Getter) -> Column:
    x, fill = segment(s, g), g("fill_value")
    empty = yes_no(F.forall(x, lambda v: F.isnan(v)), F.lit(1.0))
    return F.when(fill.isNull() | F.isnan(fill), empty).otherwise(graded(_max_abs(F.transform(x, lambda v: v - fill)), tol(g)))


def check_negation(forbidden: Column, used: Column) -> Column:
    return yes_no(F.size(F.array_intersect(forbidden, used)) == 0, F.lit(1.0))


CHECKERS: dict[str, Callable[[Column, Getter], Column]] = {
    f.__name__: f
    for f in (check_flat, check_ramp, check_growth, check_decay, check_trend, check_spike, check_dip, check_outlier, check_level_shift, check_peak, check_trough, check_change_point, check_seasonality, check_noise, check_volatility, check_gap)
}


def check(name: Column, s: Column, g: Getter) -> Column:
    """Dispatch by name; an unknown checker or a bad window cannot be evaluated."""
    out = F.when(window_error(s, g).isNotNull(), cannot())
    for n, f in CHECKERS.items():
        out = out.when(name == n, f(s, g))
    return out.otherwise(cannot())


# Queries: each checker on a window of each user's series that every second user's series fits.

_A, _B = 6, 21


def _query(check_name: str, primitive: str, build: dict, ask: dict):
    def run(spark, sf_dir):
        rows = user_series(spark, sf_dir)
        edited = P.BUILDERS[primitive](F.col("values"), P.named(**build))
        s = F.when(F.col("user_id") % 2 == 0, edited).otherwise(F.col("values"))
        c = CHECKERS[check_name](F.col("s"), P.named(**ask))
        rows = rows.select("user_id", s.alias("s")).select("user_id", c.alias("c"))
        return rows.select("user_id", "c.passed", rounded(F.col("c.score")).alias("score"), F.when(F.col("c.error") < INFINITE, rounded(F.col("c.error"))).alias("error"))

    return run


def _sql(edit: str, error: str, tolerance: str, graded: bool = True) -> str:
    """``edit``: the value at place k of the window for even users; ``x`` is the segment, ``s`` the series."""
    score = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - e / greatest(tol, 1e-12::DOUBLE)))" if graded else "CASE WHEN e <= tol THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""WITH {SERIES_SQL}, e AS (SELECT user_id, n, CASE WHEN user_id % 2 = 0 THEN list_transform(s, lambda v, i: CASE WHEN i - 1 BETWEEN {_A} AND {_B} THEN {edit} ELSE v END) ELSE s END AS s FROM (SELECT *, s[{_A + 1}] AS at_a, s[{_B + 1}] AS at_b FROM s)),
x AS (SELECT *, s[{_A + 1}:{_B + 1}] AS x, list_transform(range({_A + 2}, {_B + 2}), lambda i: s[i] - s[i - 1]) AS d FROM e),
r AS (SELECT user_id, ({error})::DOUBLE AS e, ({tolerance})::DOUBLE AS tol FROM x)
SELECT user_id, e <= tol AS passed, {rounded_sql(score)} AS score, {rounded_sql('e')} AS error FROM r"""


_W = {"start_timestep": _A, "end_timestep": _B}
_STD = "sqrt(list_avg(list_transform({x}, lambda v: (v - list_avg({x})) * (v - list_avg({x})))))"
_CHANGE = "abs(x[16] - x[1])"
_RAMP_TOL = f"greatest(1e-6::DOUBLE, 0.02::DOUBLE * greatest({_CHANGE}, 1.0::DOUBLE))"
_GROWN = "10.0::DOUBLE + 80.0::DOUBLE * (exp((i - 7) * 2.0::DOUBLE / 15) - 1) / (exp(2.0::DOUBLE) - 1)"
_DECAYED = "90.0::DOUBLE - 80.0::DOUBLE * (1 - exp(-((i - 7) * 2.0::DOUBLE / 15))) / (1 - exp(-2.0::DOUBLE))"
_CURVE = {"start_value": 10.0, "end_value": 90.0, "growth_rate": 2.0}
_FALL = {"start_value": 90.0, "end_value": 10.0, "decay_rate": 2.0}
_PROM = "greatest(1e-6::DOUBLE, 1e-4::DOUBLE * greatest(1.0::DOUBLE, abs(s[13]), abs(s[12]), abs(s[14])))"


def _stands(sign: str) -> str:
    """Error of a qualitative extreme at timestep 12: 0 where it stands out."""
    best = f"{sign}s[13]"
    top, nxt = f"list_max(list_transform(x, lambda v: {sign}v))", f"list_max(list_filter(list_transform(x, lambda v: {sign}v), lambda v: v < list_max(list_transform(x, lambda u: {sign}u))))"
    return f"CASE WHEN {best} >= {top} - 1e-8::DOUBLE AND {best} - {nxt} > {_PROM} THEN 0 ELSE greatest(0.0::DOUBLE, {_PROM} - ({best} - {nxt})) + CASE WHEN {best} >= {top} - 1e-8::DOUBLE THEN 0 ELSE 0 END END"


for _name, _check, _primitive, _build, _ask, _sql_text in [
    ("k01_check_flat", "check_flat", "add_flat", {**_W, "target_value": 7.5}, {**_W, "target_value": 7.5}, _sql("7.5::DOUBLE", f"greatest(list_max(list_transform(x, lambda v: abs(v - 7.5::DOUBLE))), {_STD.format(x='x')})", "1e-6")),
    ("k01_check_flat_free", "check_flat", "add_flat", {**_W, "target_value": 7.5}, {**_W, "tolerance": 20.0}, _sql("7.5::DOUBLE", _STD.format(x="x"), "20.0")),
    ("k02_check_ramp", "check_ramp", "add_ramp", {**_W, "start_value": 10.0, "end_value": 90.0}, {**_W, "start_value": 10.0, "end_value": 90.0, "tolerance": 60.0}, _sql("10.0::DOUBLE + (i - 7) * 80.0::DOUBLE / 15", "list_max(list_transform(x, lambda v, j: abs(v - (10.0::DOUBLE + (j - 1) * 80.0::DOUBLE / 15))))", "60.0")),
    ("k02_check_ramp_free", "check_ramp", "add_ramp", {**_W, "start_value": 10.0, "end_value": 90.0}, _W, _sql("10.0::DOUBLE + (i - 7) * 80.0::DOUBLE / 15", f"greatest(least(greatest(0.0::DOUBLE, -list_min(d)), greatest(0.0::DOUBLE, list_max(d))), {_STD.format(x='d')}, CASE WHEN {_CHANGE} <= {_RAMP_TOL} THEN {_RAMP_TOL} ELSE 0 END)", _RAMP_TOL)),
    ("k03_check_growth", "check_growth", "add_growth", {**_W, **_CURVE}, {**_W, **_CURVE, "tolerance": 60.0}, _sql(_GROWN, f"greatest(0.0::DOUBLE, -list_min(d), abs(x[1] - 10.0::DOUBLE), abs(x[16] - 90.0::DOUBLE), list_max(list_transform(x, lambda v, j: abs(v - ({_GROWN.replace('(i - 7)', '(j - 1)')})))))", "60.0")),
    ("k04_check_decay", "check_decay", "add_decay", {**_W, **_FALL}, {**_W, **_FALL, "tolerance": 60.0}, _sql(_DECAYED, f"greatest(0.0::DOUBLE, list_max(d), abs(x[1] - 90.0::DOUBLE), abs(x[16] - 10.0::DOUBLE), list_max(list_transform(x, lambda v, j: abs(v - ({_DECAYED.replace('(i - 7)', '(j - 1)')})))))", "60.0")),
    ("k05_check_trend", "check_trend", "add_ramp", {**_W, "start_value": 0.0, "slope": 2.0}, {**_W, "slope": 2.0, "tolerance": 40.0}, _sql("(i - 7) * 30.0::DOUBLE / 15", "list_max(list_transform(x, lambda v, j: abs(v - x[1] - (j - 1) * 2.0::DOUBLE)))", "40.0")),
    ("k06_check_spike", "check_spike", "add_outlier", {"timestep": 12, "target_value": 400.0}, {**_W, "timestep": 12, "amplitude": 350.0, "tolerance": 400.0}, _sql("CASE WHEN i = 13 THEN 400.0::DOUBLE ELSE v END", "abs(s[13] - s[12] - 350.0::DOUBLE)", "400.0")),
    ("k07_check_dip", "check_dip", "add_outlier", {"timestep": 12, "target_value": -400.0}, {**_W, "timestep": 12, "amplitude": 350.0, "tolerance": 400.0}, _sql("CASE WHEN i = 13 THEN -400.0::DOUBLE ELSE v END", "abs(s[12] - s[13] - 350.0::DOUBLE)", "400.0")),
    ("k08_check_outlier", "check_outlier", "add_outlier", {"timestep": 12, "target_value": -9.0}, {**_W, "timestep": 12, "target_value": -9.0, "tolerance": 30.0}, _sql("CASE WHEN i = 13 THEN -9.0::DOUBLE ELSE v END", "abs(s[13] + 9.0::DOUBLE)", "30.0")),
    ("k09_check_level_shift", "check_level_shift", "add_flat", {**_W, "target_value": 50.0}, {**_W, "shift": 20.0, "tolerance": 80.0}, _sql("50.0::DOUBLE", "list_max(list_transform(x, lambda v: abs(v - s[6] - 20.0::DOUBLE)))", "80.0")),
    ("k10_check_peak", "check_peak", "add_outlier", {"timestep": 12, "target_value": 400.0}, {**_W, "timestep": 12}, _sql("CASE WHEN i = 13 THEN 400.0::DOUBLE ELSE v END", _stands(""), "0.0", graded=False)),
    ("k11_check_trough", "check_trough", "add_outlier", {"timestep": 12, "target_value": -400.0}, {**_W, "timestep": 12}, _sql("CASE WHEN i = 13 THEN -400.0::DOUBLE ELSE v END", _stands("-"), "0.0", graded=False)),
    ("k12_check_change_point", "check_change_point", "add_flat", {**_W, "target_value": 50.0}, {**_W, "level_change": 20.0, "tolerance": 50.0}, _sql("50.0::DOUBLE", "abs(s[7] - s[6] - 20.0::DOUBLE)", "50.0")),
    ("k14_check_noise", "check_noise", "add_flat", {**_W, "target_value": 50.0}, {**_W, "noise_scale": 2.0}, _sql("50.0::DOUBLE", f"CASE WHEN {_STD.format(x='x')} >= 0.1::DOUBLE THEN 0 ELSE 0.1::DOUBLE - {_STD.format(x='x')} END", "0.0", graded=False)),
    ("k15_check_volatility", "check_volatility", "add_flat", {**_W, "target_value": 50.0}, _W, _sql("50.0::DOUBLE", "0.0", "0.0", graded=False)),
    ("k16_check_gap", "check_gap", "add_gap", {**_W, "fill_value": -1.0}, {**_W, "fill_value": -1.0, "tolerance": 90.0}, _sql("-1.0::DOUBLE", "list_max(list_transform(x, lambda v: abs(v + 1.0::DOUBLE)))", "90.0")),
]:
    register(_name, _query(_check, _primitive, _build, _ask), _sql_text)

_SEASON = {"amplitude": 30.0, "period": 8.0}
_SEASON_SQL = f"""WITH {SERIES_SQL}, e AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN list_transform(range(0, 16), lambda k: 20.0::DOUBLE + 30.0::DOUBLE * sin(2 * pi() * k / 8.0::DOUBLE)) ELSE s[{_A + 1}:{_B + 1}] END AS x FROM s),
f AS (SELECT user_id, x, b.k, pow(list_sum(list_transform(x, lambda v, i: (v - list_avg(x)) * cos(2 * pi() * b.k * (i - 1) / 16.0::DOUBLE))), 2) + pow(list_sum(list_transform(x, lambda v, i: (v - list_avg(x)) * sin(2 * pi() * b.k * (i - 1) / 16.0::DOUBLE))), 2) AS power FROM e, (SELECT unnest(range(1, 9)) AS k) b),
r AS (SELECT user_id, abs((list_max(any_value(x)) - list_min(any_value(x))) / 2 - 30.0::DOUBLE) AS ae, abs(16.0::DOUBLE / arg_max(k, power) - 8.0::DOUBLE) / 8.0::DOUBLE AS pe FROM f GROUP BY user_id),
g AS (SELECT user_id, ae <= 6.0::DOUBLE AND pe <= 0.25::DOUBLE AS passed, greatest(ae / 6.0::DOUBLE, pe) AS error FROM r)
SELECT user_id, passed, {rounded_sql("CASE WHEN passed THEN 1 ELSE greatest(0.0::DOUBLE, 1 - least(error, 1.0::DOUBLE)) END")} AS score, {rounded_sql("error")} AS error FROM g"""


def _k13(spark, sf_dir):
    """Amplitude and dominant period by a discrete Fourier transform over the window."""
    rows = user_series(spark, sf_dir)
    flat = P.add_flat(F.col("values"), P.named(**_W, target_value=20.0))
    s = F.when(F.col("user_id") % 2 == 0, P.add_seasonality(flat, P.named(**_W, **_SEASON))).otherwise(F.col("values"))
    rows = rows.select("user_id", s.alias("s")).select("user_id", check_seasonality(F.col("s"), P.named(**_W, **_SEASON)).alias("c"))
    return rows.select("user_id", "c.passed", rounded(F.col("c.score")).alias("score"), rounded(F.col("c.error")).alias("error"))


register("k13_check_seasonality", _k13, _SEASON_SQL)


def _k17(spark, sf_dir):
    """Forbidden primitives must not be among those used."""
    used = F.filter(F.array(F.lit("add_flat"), F.when(F.col("user_id") % 2 == 0, "add_spike"), F.when(F.col("user_id") % 3 == 0, "add_gap")), lambda x: x.isNotNull())
    return user_series(spark, sf_dir).select("user_id", check_negation(F.array(F.lit("add_spike"), F.lit("add_dip")), used).alias("c")).select("user_id", "c.passed", "c.score", "c.error")


register("k17_check_negation", _k17, "SELECT user_id, user_id % 2 <> 0 AS passed, (user_id % 2 <> 0)::INT::DOUBLE AS score, (user_id % 2 = 0)::INT::DOUBLE AS error FROM (SELECT DISTINCT user_id FROM events)")


def _k19(spark, sf_dir):
    """How far an extreme must stand out, at each timestep (K19, with the neighbours of K18)."""
    s = F.col("values")
    rows = user_series(spark, sf_dir).select("user_id", F.posexplode(F.transform(s, lambda v, i: prominence_tolerance(s, i))).alias("t", "tolerance"))
    return rows.select("user_id", "t", rounded(F.col("tolerance"), 9).alias("tolerance"))


register("k19_prominence", _k19, f"WITH {SERIES_SQL}, x AS (SELECT user_id, s, n, unnest(range(1, n + 1)) AS i FROM s) SELECT user_id, (i - 1)::INT AS t, {rounded_sql('greatest(1e-6::DOUBLE, 1e-4::DOUBLE * greatest(1.0::DOUBLE, abs(s[i]), CASE WHEN i > 1 THEN abs(s[i - 1]) ELSE 0 END, CASE WHEN i < n THEN abs(s[i + 1]) ELSE 0 END))', 9)} AS tolerance FROM x")


def _k21(spark, sf_dir):
    """Dispatch by name, with a bad window and an unknown name among them."""
    asks = [("check_flat", 3.0, 9.0), ("check_noise", 3.0, 9.0), ("check_volatility", 3.0, 9.0), ("check_gap", 3.0, 9.0), ("check_noise", 9.0, 3.0), ("check_nothing", 3.0, 9.0)]
    rows = user_series(spark, sf_dir).crossJoin(F.broadcast(spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "q int, name string, a double, b double")))
    g = lambda k: {"start_timestep": F.col("a"), "end_timestep": F.col("b")}.get(k, F.lit(None).cast("double"))
    return rows.select("user_id", "q", check(F.col("name"), F.col("values"), g).alias("c")).select("user_id", "q", "c.passed")


register("k21_dispatch", _k21, f"WITH {SERIES_SQL}, q AS (SELECT unnest(range(0, 6))::INT AS q) SELECT user_id, q, CASE q WHEN 0 THEN {_STD.format(x='s[4:10]')} <= 1e-6::DOUBLE WHEN 1 THEN {_STD.format(x='s[4:10]')} > 1e-8::DOUBLE WHEN 2 THEN TRUE ELSE FALSE END AS passed FROM s, q")
