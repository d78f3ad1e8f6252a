"""Queries of the series primitives over the users' event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, register
from ..functions import primitives as P
from ..sources.series import POINTS_SQL, points, rounded, rounded_sql, user_series

#: id, primitive, arguments, SQL of the value inside the window (a, b, L, k and at[i] as below)
_WINDOW = {"start_timestep": 5, "end_timestep": 30}
CASES = [
    ("p01_add_trend", "add_trend", {**_WINDOW, "slope": 0.5}, "v + k * 0.5::DOUBLE"),
    ("p01_add_trend_endpoints", "add_trend", {**_WINDOW, "start_value": 1.0, "end_value": 4.0}, "v + CASE WHEN k = 25 THEN 4.0::DOUBLE ELSE 1 + k * 3.0::DOUBLE / 25 END"),
    ("p02_add_ramp", "add_ramp", {**_WINDOW, "end_value": 90.0}, "CASE WHEN k = 25 THEN 90.0::DOUBLE ELSE at5 + k * (90.0::DOUBLE - at5) / 25 END"),
    ("p02_add_ramp_slope", "add_ramp", {**_WINDOW, "slope": 2.0, "start_value": 3.0}, "3.0::DOUBLE + k * 50.0::DOUBLE / 25"),
    ("p03_add_flat", "add_flat", {**_WINDOW, "target_value": 7.5}, "7.5::DOUBLE"),
    ("p04_add_growth", "add_growth", {**_WINDOW, "growth_rate": 2.0}, "at5 + (at30 - at5) * (exp(k * 2.0::DOUBLE / 25) - 1) / (exp(2.0::DOUBLE) - 1)"),
    ("p05_add_decay", "add_decay", {**_WINDOW, "start_value": 10.0, "end_value": 2.0, "decay_rate": 2.0}, "10.0::DOUBLE - 8.0::DOUBLE * (1 - exp(-(k * 2.0::DOUBLE / 25))) / (1 - exp(-2.0::DOUBLE))"),
    ("p06_add_plateau", "add_plateau", {**_WINDOW, "anchor_timestep": 33}, "at33"),
    ("p07_add_change_point", "add_change_point", {"anchor_timestep": 5, "end_timestep": 30, "level_change": 2.0, "slope_change": 1.0}, "v + 2.0::DOUBLE + k"),
    ("p08_add_peak", "add_peak", {**_WINDOW, "timestep": 12, "target_value": 200.0, "width": 1.5}, "v + (200.0::DOUBLE - at12) * exp(-0.5::DOUBLE * pow((t - 12) / 1.5::DOUBLE, 2))"),
    ("p09_add_trough", "add_trough", {**_WINDOW, "timestep": 12, "target_value": 200.0, "width": 1.5}, "v - abs(200.0::DOUBLE - at12) * exp(-0.5::DOUBLE * pow((t - 12) / 1.5::DOUBLE, 2))"),
    ("p10_add_spike", "add_spike", {"timestep": 12, "amplitude": 40.0, "width": 2}, "v + 40.0::DOUBLE * (1 - abs(t - 12) / 3.0::DOUBLE)"),
    ("p11_add_dip", "add_dip", {"timestep": 12, "amplitude": 40.0, "width": 2}, "v - 40.0::DOUBLE * (1 - abs(t - 12) / 3.0::DOUBLE)"),
    ("p12_add_outlier", "add_outlier", {"timestep": 12, "delta": -0.5}, "v - 0.5::DOUBLE"),
    ("p13_add_seasonality", "add_seasonality", {**_WINDOW, "amplitude": 2.0, "period": 7.0, "phase": 0.25, "baseline": 1.0}, "v + 1.0::DOUBLE + 2.0::DOUBLE * sin(2 * pi() * k / 7.0::DOUBLE + 0.25::DOUBLE)"),
    ("p15_add_volatility", "add_volatility", {**_WINDOW, "volatility_scale": 2.0}, "mean + (v - mean) * 2.0::DOUBLE"),
    ("p16_add_level_shift", "add_level_shift", {**_WINDOW, "target_value": 50.0}, "v + 50.0::DOUBLE - at5"),
    ("p17_add_gap", "add_gap", {**_WINDOW, "fill_value": -1.0}, "-1.0::DOUBLE"),
]
_BOUNDS = {"p10_add_spike": (10, 14), "p11_add_dip": (10, 14), "p12_add_outlier": (12, 12)}


def _sql(value: str, a: int, b: int) -> str:
    anchors = ", ".join(f"max(CASE WHEN t = {i} THEN v END) OVER (PARTITION BY user_id) AS at{i}" for i in (5, 12, 30, 33) if f"at{i}" in value)
    mean = f"avg(CASE WHEN t BETWEEN {a} AND {b} THEN v END) OVER (PARTITION BY user_id) AS mean" if "mean" in value else ""
    more = "".join(f", {x}" for x in (anchors, mean) if x)
    return f"WITH {POINTS_SQL}, x AS (SELECT user_id, t, v, t - {a} AS k{more} FROM p) SELECT user_id, t::INT AS t, {rounded_sql(f'CASE WHEN t BETWEEN {a} AND {b} THEN {value} ELSE v END')} AS v FROM x"


def _spark(name: str, arguments: dict):
    def run(spark, sf_dir):
        series = user_series(spark, sf_dir).select("user_id", P.BUILDERS[name](F.col("values"), P.named(**arguments)).alias("values"))
        return points(series, "user_id").withColumn("v", rounded(F.col("v")))

    return run


for _name, _primitive, _arguments, _value in CASES:
    register(_name, _spark(_primitive, _arguments), _sql(_value, *_BOUNDS.get(_name, (5, 30))))


@query("p14_add_noise")
def p14(spark, sf_dir):
    """Seeded normals come from NumPy's generator; only determinism can be checked, in the tests."""
    g = P.named(start_timestep=5, end_timestep=30, noise_scale=0.5, random_seed=7)
    series = user_series(spark, sf_dir).withColumn("z", P.noise_vector(F.col("values"), g))
    return points(series.select("user_id", P.add_noise(F.col("values"), g, F.col("z")).alias("values")), "user_id").withColumn("v", rounded(F.col("v")))


_GUARD_ROWS = [("add_trend", None, None, None), ("add_trend", -1, 4, None), ("add_flat", 3, 400, None), ("add_flat", 9, 3, None), ("add_peak", 0, 5, 9), ("add_spike", None, None, 70), ("add_growth", 5, 30, None)]


@query(
    "p18_interval_guard",
    f"""WITH {POINTS_SQL}, n AS (SELECT user_id, max(n) AS n FROM p GROUP BY user_id),
g(g, name, a, b, c) AS (VALUES {", ".join(f"({i}, '{n}', {a if a is not None else 'NULL'}, {b if b is not None else 'NULL'}, {c if c is not None else 'NULL'})" for i, (n, a, b, c) in enumerate(_GUARD_ROWS))}),
x AS (SELECT user_id, g, name, coalesce(a, 0) AS a, coalesce(b, n - 1) AS b, c, n - 1 AS m FROM n, g)
SELECT user_id, g::INT AS g, CASE WHEN name IN ('add_peak', 'add_spike') AND (c IS NULL OR c < 0 OR c > m) THEN 'timestep_out_of_range'
 WHEN name <> 'add_spike' AND (a < 0 OR b < 0) THEN 'negative_timestep' WHEN name <> 'add_spike' AND (a > m OR b > m) THEN 'timestep_out_of_range' WHEN name <> 'add_spike' AND b < a THEN 'end_before_start'
 WHEN name = 'add_peak' AND (c < a OR c > b) THEN 'window_without_center' END AS error FROM x""",
)
def p18(spark, sf_dir):
    """Guards of intervals, timesteps and bump windows, as data."""
    guards = spark.createDataFrame([(i, n, *(float(x) if x is not None else None for x in rest)) for i, (n, *rest) in enumerate(_GUARD_ROWS)], "g int, name string, a double, b double, c double")
    rows = user_series(spark, sf_dir).crossJoin(F.broadcast(guards))
    g = lambda k: {"start_timestep": F.col("a"), "end_timestep": F.col("b"), "timestep": F.col("c")}.get(k, F.lit(None).cast("double"))
    return rows.select("user_id", "g", P.value_error(F.col("name"), F.col("values"), g, F.lit("sine")).alias("error"))


@query("p20_amplitude", f"WITH {POINTS_SQL} SELECT user_id, t::INT AS t, {rounded_sql('CASE WHEN t % 2 = 0 THEN 80 - v ELSE 5.0::DOUBLE END')} AS amplitude FROM p")
def p20(spark, sf_dir):
    """The change that an event makes: up to a target, or as stated."""
    rows = points(user_series(spark, sf_dir), "user_id")
    g = lambda k: F.when((F.col("t") % 2 == 0) == F.lit(k == "target_value"), F.lit(80.0 if k == "target_value" else 5.0))
    return rows.select("user_id", "t", rounded(P.amplitude(F.col("v"), g)).alias("amplitude"))


_SIGMOID = "(1 / (1 + exp(-10 * ({}))))"


@query("p21_smooth_step", f"WITH {POINTS_SQL} SELECT user_id, t::INT AS t, {rounded_sql('(' + _SIGMOID.format('-1 + 2.0::DOUBLE * t / (n - 1)') + ' - ' + _SIGMOID.format('-1.0::DOUBLE') + ') / (' + _SIGMOID.format('1.0::DOUBLE') + ' - ' + _SIGMOID.format('-1.0::DOUBLE') + ')')} AS w FROM p")
def p21(spark, sf_dir):
    """Logistic weights from 0 to 1 over each series."""
    s = F.col("values")
    weights = F.transform(s, lambda v, i: P.logistic_step(F.size(s), i))
    return points(user_series(spark, sf_dir).select("user_id", weights.alias("values")), "user_id").select("user_id", "t", rounded(F.col("v")).alias("w"))


@query("p13_waveforms", f"""WITH {POINTS_SQL}, k(kind) AS (VALUES ('sine'), ('cosine'), ('square'), ('sawtooth'), ('triangle')),
x AS (SELECT user_id, t, kind, 2 * pi() * t / 7.3::DOUBLE + 0.1::DOUBLE AS a, (2 * pi() * t / 7.3::DOUBLE + 0.1::DOUBLE) % (2 * pi()) AS m FROM p, k)
SELECT user_id, t::INT AS t, kind, {rounded_sql("CASE kind WHEN 'sine' THEN sin(a) WHEN 'cosine' THEN cos(a) WHEN 'square' THEN CASE WHEN m < pi() THEN 1 ELSE -1 END WHEN 'sawtooth' THEN m / pi() - 1 ELSE CASE WHEN m < pi() THEN 2 * m / pi() - 1 ELSE 3 - 2 * m / pi() END END")} AS w FROM x""")
def p13_waves(spark, sf_dir):
    """The five waveforms along each series."""
    kinds = spark.createDataFrame([(k,) for k in ("sine", "cosine", "square", "sawtooth", "triangle")], "kind string")
    rows = points(user_series(spark, sf_dir), "user_id").crossJoin(F.broadcast(kinds))
    return rows.select("user_id", "t", "kind", rounded(P.wave(F.col("kind"), 2 * 3.141592653589793 * F.col("t") / 7.3 + 0.1)).alias("w"))
