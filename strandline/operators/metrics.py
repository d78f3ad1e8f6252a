"""Error, realism and locality metrics of series pairs, and checks of a final signal.

Pairs are compared in long form, one aggregation by case; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import primitives as P
from ..sources.series import POINTS_SQL, points, rounded, rounded_sql, user_series
from .nearest import nearest

EPSILON = 1e-8


def pearson(x: Column, y: Column) -> Column:
    """Null where either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.try_divide(F.covar_pop(x, y), spread))


def pairs(generated: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Rows ``keys, t, g, r`` of two point tables."""
    return generated.select(*keys, "t", F.col("v").alias("g")).join(truth.select(*keys, "t", F.col("v").alias("r")), [*keys, "t"])


def error_metrics(rows: DataFrame, *keys: str, epsilon: float = EPSILON) -> DataFrame:
    """mse, rmse, mae, mrr, wape, normalized forms, largest error and correlation by case."""
    e = F.col("g") - F.col("r")
    base = rows.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(e) / F.greatest(F.abs("r"), F.lit(epsilon))).alias("mrr"),
        (F.sum(F.abs(e)) / F.greatest(F.sum(F.abs("r")), F.lit(epsilon))).alias("wape"), F.max(F.abs(e)).alias("max_abs_error"), pearson(F.col("g"), F.col("r")).alias("correlation"),
        (F.max("r") - F.min("r")).alias("_range"), F.stddev_pop("r").alias("_std"),
    )
    span, std = F.greatest("_range", F.lit(epsilon)), F.greatest("_std", F.lit(epsilon))
    return base.withColumns({"rmse": F.sqrt("mse"), "range_mse": F.col("mse") / (span * span), "range_rmse": F.sqrt("mse") / span, "std_rmse": F.sqrt("mse") / std}).drop("_range", "_std")


def realism_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Errors of mean, deviation, range and lag-1 autocorrelation by case, with normalized rmse and mae."""
    order = Window.partitionBy(*keys).orderBy("t")
    e = F.col("g") - F.col("r")
    rows = rows.withColumns({"g1": F.lead("g").over(order), "r1": F.lead("r").over(order)})
    size = F.greatest(F.max("r") - F.min("r"), F.abs(F.avg("r")), F.lit(1e-6))
    lag = lambda x, y: pearson(F.when(F.col(y).isNotNull(), F.col(x)), F.col(y))
    return rows.groupBy(*keys).agg(
        (F.sqrt(F.avg(e * e)) / size).alias("normalized_rmse"), (F.avg(F.abs(e)) / size).alias("normalized_mae"), F.abs(F.avg("g") - F.avg("r")).alias("mean_error"),
        F.abs(F.stddev_pop("g") - F.stddev_pop("r")).alias("std_error"), F.abs(F.max("g") - F.min("g") - F.max("r") + F.min("r")).alias("range_error"), F.abs(lag("g", "g1") - lag("r", "r1")).alias("autocorrelation_error"),
    )


def locality_metrics(rows: DataFrame, *keys: str, mask: str = "mask") -> DataFrame:
    """Change inside an edit's mask and drift outside, by the base's scale."""
    change = F.abs(F.col("g") - F.col("r"))
    out = rows.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col(mask), change)), F.lit(0.0)).alias("_in"), F.coalesce(F.avg(F.when(~F.col(mask), change)), F.lit(0.0)).alias("_out"),
        F.greatest(F.max("r") - F.min("r"), F.abs(F.avg("r")), F.lit(1e-6)).alias("_size"),
    )
    inside, outside = F.col("_in") / F.col("_size"), F.col("_out") / F.col("_size")
    return out.select(*keys, inside.alias("inside_change"), outside.alias("outside_drift"), (inside / (1 + outside)).alias("locality"))


def numeric_range(values: Column, padding: float = 0.05, least: float = 1e-6, of_span_floor: float = 0.0) -> tuple[Column, Column]:
    """Minimum and maximum (aggregates) with padding by the span."""
    low, high = F.min(values), F.max(values)
    pad = F.greatest(padding * F.greatest(high - low, F.lit(of_span_floor)), F.lit(least))
    return low - pad, high + pad


def min_max(rows: DataFrame, *strata: str, value: str = "v") -> DataFrame:
    """Each value scaled by its stratum's and timestep's extremes, and back."""
    w = Window.partitionBy(*strata, "t")
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = F.when(high > low, (F.col(value) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0)
    return rows.withColumns({"low": low, "high": high, "scaled": scaled}).withColumn("restored", F.col("scaled") * (F.col("high") - F.col("low")) + F.col("low"))


def forecast(spark, sf_dir: str) -> DataFrame:
    """Each user's series as truth ``r`` and the one-step lag forecast as ``g``."""
    rows = points(user_series(spark, sf_dir), "user_id")
    return rows.withColumn("g", F.coalesce(F.lag("v").over(Window.partitionBy("user_id").orderBy("t")), F.col("v"))).withColumnRenamed("v", "r")


_PAIRS_SQL = f"{POINTS_SQL}, q AS (SELECT user_id, t, v AS r, coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY t), v) AS g FROM p)"
_CORR_SQL = "CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"
_M01 = {
    "mse": "avg((g - r) * (g - r))", "rmse": "sqrt(avg((g - r) * (g - r)))", "mae": "avg(abs(g - r))", "mrr": "avg(abs(g - r) / greatest(abs(r), 1e-8))", "wape": "sum(abs(g - r)) / greatest(sum(abs(r)), 1e-8)",
    "max_abs_error": "max(abs(g - r))", "correlation": _CORR_SQL.format(x="g", y="r"), "range_mse": "avg((g - r) * (g - r)) / pow(greatest(max(r) - min(r), 1e-8), 2)",
    "range_rmse": "sqrt(avg((g - r) * (g - r))) / greatest(max(r) - min(r), 1e-8)", "std_rmse": "sqrt(avg((g - r) * (g - r))) / greatest(stddev_pop(r), 1e-8)",
}


def _round_all(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *(rounded(F.col(c)).alias(c) for c in rows.columns if c not in keys))


def _select_sql(parts: dict[str, str]) -> str:
    return ", ".join(f"{rounded_sql(v)} AS {k}" for k, v in parts.items())


@query("m01_error_metrics", f"WITH {_PAIRS_SQL} SELECT user_id, {_select_sql(_M01)} FROM q GROUP BY user_id")
def m01(spark, sf_dir):
    return _round_all(error_metrics(forecast(spark, sf_dir), "user_id"), "user_id")


@query("m02_compare_series", f"WITH {_PAIRS_SQL} SELECT user_id, {_select_sql({k: _M01[k] for k in ('rmse', 'mae', 'max_abs_error', 'correlation')})} FROM q GROUP BY user_id")
def m02(spark, sf_dir):
    return _round_all(error_metrics(forecast(spark, sf_dir), "user_id").select("user_id", "rmse", "mae", "max_abs_error", "correlation"), "user_id")


@query("m03_compare_wide_epsilon", f"WITH {_PAIRS_SQL} SELECT user_id, {_select_sql({k: _M01[k].replace('1e-8', '1e-6') for k in ('mse', 'rmse', 'mae', 'mrr', 'max_abs_error')})} FROM q GROUP BY user_id")
def m03(spark, sf_dir):
    return _round_all(error_metrics(forecast(spark, sf_dir), "user_id", epsilon=1e-6).select("user_id", "mse", "rmse", "mae", "mrr", "max_abs_error"), "user_id")


@query("m04_zero_reference_wape", f"WITH {_PAIRS_SQL}, z AS (SELECT user_id, g, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE r END AS r FROM q) SELECT user_id, {rounded_sql('CASE WHEN sum(abs(r)) > 0 THEN sum(abs(g - r)) / sum(abs(r)) END')} AS wape, sum(abs(r)) = 0 AND sum(abs(g - r)) > 0 AS infinite FROM z GROUP BY user_id")
def m04(spark, sf_dir):
    """WAPE whose reference may be all zero: 0 or infinite, here as a flag."""
    rows = forecast(spark, sf_dir).withColumn("r", F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(F.col("r")))
    total, off = F.sum(F.abs("r")), F.sum(F.abs(F.col("g") - F.col("r")))
    return rows.groupBy("user_id").agg(rounded(F.try_divide(off, total)).alias("wape"), ((total == 0) & (off > 0)).alias("infinite"))


@query(
    "m05_realism",
    f"""WITH {_PAIRS_SQL}, z AS (SELECT *, lead(g) OVER w AS g1, lead(r) OVER w AS r1 FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t)),
y AS (SELECT *, CASE WHEN g1 IS NOT NULL THEN g END AS g0, CASE WHEN r1 IS NOT NULL THEN r END AS r0 FROM z)
SELECT user_id, {_select_sql({"normalized_rmse": "sqrt(avg((g - r) * (g - r))) / greatest(max(r) - min(r), abs(avg(r)), 1e-6)", "normalized_mae": "avg(abs(g - r)) / greatest(max(r) - min(r), abs(avg(r)), 1e-6)", "mean_error": "abs(avg(g) - avg(r))", "std_error": "abs(stddev_pop(g) - stddev_pop(r))", "range_error": "abs(max(g) - min(g) - max(r) + min(r))", "autocorrelation_error": f"abs({_CORR_SQL.format(x='g0', y='g1')} - {_CORR_SQL.format(x='r0', y='r1')})"})} FROM y GROUP BY user_id""",
)
def m05(spark, sf_dir):
    return _round_all(realism_metrics(forecast(spark, sf_dir), "user_id"), "user_id")


@query("m06_lag1_autocorrelation", f"WITH {POINTS_SQL}, z AS (SELECT user_id, v, lead(v) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM p) SELECT user_id, {rounded_sql(_CORR_SQL.format(x='v', y='nx'))} AS rho FROM z WHERE nx IS NOT NULL GROUP BY user_id")
def m06(spark, sf_dir):
    rows = points(user_series(spark, sf_dir), "user_id").withColumn("nx", F.lead("v").over(Window.partitionBy("user_id").orderBy("t"))).where("nx is not null")
    return rows.groupBy("user_id").agg(rounded(pearson(F.col("v"), F.col("nx"))).alias("rho"))


_LOCAL_SQL = "avg(CASE WHEN {m} THEN abs(g - r) END) / greatest(max(r) - min(r), abs(avg(r)), 1e-6)"
_IN, _OUT = _LOCAL_SQL.format(m="t BETWEEN 10 AND 20"), _LOCAL_SQL.format(m="t NOT BETWEEN 10 AND 20")


@query("m07_locality", f"WITH {_PAIRS_SQL} SELECT user_id, {_select_sql({'inside_change': _IN, 'outside_drift': _OUT, 'locality': f'({_IN}) / (1 + {_OUT})'})} FROM q GROUP BY user_id")
def m07(spark, sf_dir):
    return _round_all(locality_metrics(forecast(spark, sf_dir).withColumn("mask", F.col("t").between(10, 20)), "user_id"), "user_id")


_EDIT = "CASE WHEN method = 'local_edit' THEN CASE WHEN mask THEN v + 5 ELSE v END ELSE CASE WHEN mask THEN v + 5 ELSE v END + (t % 3) - 1 END"


@query(
    "m08_edit_locality",
    f"""WITH {POINTS_SQL}, k(method) AS (VALUES ('local_edit'), ('rerun')), w(a, b) AS (VALUES (5, 9), (10, 20), (20, 25), (30, 40)), q AS (SELECT user_id, method, a, v AS r, {_EDIT} AS g, mask FROM (SELECT user_id, t, v, method, a, t BETWEEN a AND b AS mask FROM p, k, w)),
z AS (SELECT user_id, method, a, {_LOCAL_SQL.format(m='mask')} AS i, {_LOCAL_SQL.format(m='NOT mask')} AS o FROM q GROUP BY user_id, method, a)
SELECT method, {_select_sql({'inside_change': 'avg(i)', 'outside_drift': 'avg(o)', 'locality': 'avg(i / (1 + o))'})} FROM z GROUP BY method""",
)
def m08(spark, sf_dir):
    """Four edits by two methods over each series; means by method."""
    methods = spark.createDataFrame([(m, *w) for m in ("local_edit", "rerun") for w in ((5, 9), (10, 20), (20, 25), (30, 40))], "method string, a int, b int")
    rows = points(user_series(spark, sf_dir), "user_id").crossJoin(F.broadcast(methods)).withColumn("mask", F.col("t").between(F.col("a"), F.col("b")))
    local = F.when(F.col("mask"), F.col("v") + 5).otherwise(F.col("v"))
    rows = rows.withColumn("g", F.when(F.col("method") == "local_edit", local).otherwise(local + F.col("t") % 3 - 1)).withColumnRenamed("v", "r")
    each = locality_metrics(rows, "user_id", "method", "a")
    return each.groupBy("method").agg(*(rounded(F.avg(c)).alias(c) for c in ("inside_change", "outside_drift", "locality")))


@query("m09_numeric_range", f"WITH {POINTS_SQL} SELECT user_id, {_select_sql({'low': 'min(v) - greatest(0.05 * (max(v) - min(v)), 1e-6)', 'high': 'max(v) + greatest(0.05 * (max(v) - min(v)), 1e-6)', 'wide_low': 'min(v) - greatest(0.1 * (max(v) - min(v)), 1.0)'})} FROM p GROUP BY user_id")
def m09(spark, sf_dir):
    rows = points(user_series(spark, sf_dir), "user_id")
    (low, high), (wide, _) = numeric_range(F.col("v")), numeric_range(F.col("v"), 0.1, 1.0)
    return _round_all(rows.groupBy("user_id").agg(low.alias("low"), high.alias("high"), wide.alias("wide_low")), "user_id")


@query("m10_min_max_scaling", f"WITH {POINTS_SQL}, z AS (SELECT user_id, t, v, min(v) OVER w AS low, max(v) OVER w AS high FROM p WINDOW w AS (PARTITION BY user_id % 4, t)) SELECT user_id, t::INT AS t, {_select_sql({'scaled': 'CASE WHEN high > low THEN (v - low) / nullif(high - low, 0) ELSE 0 END', 'restored': 'CASE WHEN high > low THEN (v - low) / nullif(high - low, 0) ELSE 0 END * (high - low) + low'})} FROM z")
def m10(spark, sf_dir):
    rows = points(user_series(spark, sf_dir), "user_id").withColumn("dataset", F.col("user_id") % 4)
    return _round_all(min_max(rows, "dataset").select("user_id", "t", "scaled", "restored"), "user_id", "t")


@query("x09_series_summary", f"WITH {POINTS_SQL} SELECT user_id, count(*)::INT AS length, {_select_sql({'min': 'min(v)', 'max': 'max(v)', 'mean': 'avg(v)', 'std': 'stddev_pop(v)'})}, string_agg(CASE WHEN t < 8 THEN v::DECIMAL(18, 2)::VARCHAR END, ' ' ORDER BY t) AS first, string_agg(CASE WHEN t >= n - 8 THEN v::DECIMAL(18, 2)::VARCHAR END, ' ' ORDER BY t) AS last FROM p GROUP BY user_id")
def x09(spark, sf_dir):
    """Summary of each series with its first and last eight values."""
    s = F.col("values")
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("decimal(18,2)").cast("string")), " ")
    rows = user_series(spark, sf_dir).select("user_id", F.posexplode(s).alias("t", "v"), text(F.slice(s, 1, 8)).alias("first"), text(F.slice(s, -8, 8)).alias("last"))
    out = rows.groupBy("user_id", "first", "last").agg(F.count("*").cast("int").alias("length"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return _round_all(out, "user_id", "length", "first", "last")


# Checks of a final signal. A check names a window; the rows are points with the check's bounds.

_CHECKS = """WITH {p}, x AS (SELECT user_id, t, v, n, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS b FROM (SELECT user_id, t, n, CASE WHEN user_id % 2 = 0 AND t BETWEEN 5 AND 12 THEN 50.0 WHEN user_id % 2 = 0 AND t BETWEEN 13 AND 20 THEN 50.0 + t ELSE v END AS v FROM p))"""


def edited_points(spark, sf_dir) -> DataFrame:
    """Every second user's series with a constant and a rising stretch."""
    even, t = F.col("user_id") % 2 == 0, F.col("t")
    v = F.when(even & t.between(5, 12), 50.0).when(even & t.between(13, 20), 50.0 + t).otherwise(F.col("v"))
    return points(user_series(spark, sf_dir), "user_id").withColumn("v", v)


def _inside(a: int, b: int, x: str | Column = "v") -> Column:
    return F.when(F.col("t").between(a, b), F.col(x) if isinstance(x, str) else x)


@query(
    "s01_signal_checks",
    _CHECKS.format(p=POINTS_SQL)
    + """ SELECT user_id, max(n) = 60 AS length, coalesce(max(CASE WHEN t = 7 THEN abs(v - 50) END) <= 1e-6, FALSE) AS point_value,
 greatest(max(CASE WHEN t BETWEEN 5 AND 12 THEN abs(v - 50) END), stddev_pop(CASE WHEN t BETWEEN 5 AND 12 THEN v END)) <= 1e-6 AS constant_segment, stddev_pop(CASE WHEN t BETWEEN 5 AND 12 THEN v END) <= 1e-6 AS unchanged_window,
 min(CASE WHEN t BETWEEN 14 AND 20 THEN v - b END) >= -1e-8 AS monotone_up, max(CASE WHEN t BETWEEN 14 AND 20 THEN v - b END) <= 1e-8 AS monotone_down, arg_max(t, (v, -t)) BETWEEN 10 AND 40 AS argmax_in, arg_min(t, (v, t)) BETWEEN 10 AND 40 AS argmin_in,
 greatest(0 - min(v), max(v) - 100, 0) <= 1e-8 AS value_bounds, stddev_pop(CASE WHEN t BETWEEN 5 AND 12 THEN v END) > 1e-12 AS nonconstant,
 stddev_pop(CASE WHEN t BETWEEN 25 AND 40 THEN v END) > stddev_pop(CASE WHEN t BETWEEN 5 AND 12 THEN v END) AS variance_higher, TRUE AS periodicity_hint, TRUE AS deterministic_seed FROM x GROUP BY user_id""",
)
def s01(spark, sf_dir):
    """The twelve final-signal checks (S01 to S12) in one aggregation."""
    x = edited_points(spark, sf_dir).withColumn("step", F.col("v") - F.lag("v").over(Window.partitionBy("user_id").orderBy("t")))
    spread = lambda a, b: F.stddev_pop(_inside(a, b))
    off = F.max(_inside(5, 12, F.abs(F.col("v") - 50)))
    return x.groupBy("user_id").agg(
        (F.count("*") == 60).alias("length"), F.coalesce(F.max(F.when(F.col("t") == 7, F.abs(F.col("v") - 50))) <= 1e-6, F.lit(False)).alias("point_value"), (F.greatest(off, spread(5, 12)) <= 1e-6).alias("constant_segment"),
        (spread(5, 12) <= 1e-6).alias("unchanged_window"), (F.min(_inside(14, 20, "step")) >= -1e-8).alias("monotone_up"), (F.max(_inside(14, 20, "step")) <= 1e-8).alias("monotone_down"),
        F.max_by("t", F.struct(F.col("v"), -F.col("t"))).between(10, 40).alias("argmax_in"), F.min_by("t", F.struct("v", "t")).between(10, 40).alias("argmin_in"), (F.greatest(0 - F.min("v"), F.max("v") - 100, F.lit(0.0)) <= 1e-8).alias("value_bounds"),
        (spread(5, 12) > 1e-12).alias("nonconstant"), (spread(25, 40) > spread(5, 12)).alias("variance_higher"), F.lit(True).alias("periodicity_hint"), F.lit(True).alias("deterministic_seed"),
    )


@query(
    "n04_uncovered_islands",
    f"""WITH {POINTS_SQL}, g AS (SELECT user_id, t, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS island, v FROM p WHERE v < 40)
SELECT user_id, min(t)::INT AS start, max(t)::INT AS "end", count(*) AS points FROM g GROUP BY user_id, island""",
)
def n04(spark, sf_dir):
    """Gaps and islands: runs of timesteps that a condition covers."""
    rows = points(user_series(spark, sf_dir), "user_id").where("v < 40")
    rows = rows.withColumn("island", F.col("t") - F.row_number().over(Window.partitionBy("user_id").orderBy("t")))
    return rows.groupBy("user_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("points")).drop("island")


@query(
    "n06_local_extrema",
    f"""WITH {POINTS_SQL}, x AS (SELECT user_id, t, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
e AS (SELECT user_id, t, CASE WHEN v > b AND v > a THEN 'high' ELSE 'low' END AS kind, least(abs(v - b), abs(v - a)) AS prominence FROM x WHERE (v > b AND v > a) OR (v < b AND v < a))
SELECT user_id, t::INT AS t, kind, {rounded_sql('prominence')} AS prominence, row_number() OVER (PARTITION BY user_id, kind ORDER BY prominence DESC, t DESC)::INT AS rank FROM e""",
)
def n06(spark, sf_dir):
    """Strict interior extrema by prominence, later first among equals."""
    order = Window.partitionBy("user_id").orderBy("t")
    x = points(user_series(spark, sf_dir), "user_id").withColumns({"b": F.lag("v").over(order), "a": F.lead("v").over(order)})
    high, low = (F.col("v") > F.col("b")) & (F.col("v") > F.col("a")), (F.col("v") < F.col("b")) & (F.col("v") < F.col("a"))
    e = x.where(high | low).select("user_id", "t", F.when(high, "high").otherwise("low").alias("kind"), F.least(F.abs(F.col("v") - F.col("b")), F.abs(F.col("v") - F.col("a"))).alias("p"))
    rank = F.row_number().over(Window.partitionBy("user_id", "kind").orderBy(F.desc("p"), F.desc("t")))
    return e.select("user_id", "t", "kind", rounded(F.col("p")).alias("prominence"), rank.alias("rank"))


@query(
    "g11_nearest_series",
    f"""WITH {POINTS_SQL}, d AS (SELECT a.user_id AS q, b.user_id AS m, sqrt(avg((a.v - b.v) * (a.v - b.v))) AS rmse FROM p a JOIN p b ON a.t = b.t AND a.user_id <> b.user_id WHERE a.user_id % 50 = 0 GROUP BY a.user_id, b.user_id),
s AS (SELECT user_id, max(v) - min(v) AS span FROM p GROUP BY user_id), b AS (SELECT q, arg_min(m, (rmse, m)) AS nearest, min(rmse) AS r FROM d GROUP BY q)
SELECT q AS user_id, nearest, {rounded_sql('r')} AS rmse, r / greatest(span, 1e-8) <= 0.10 AS accepted FROM b JOIN s ON s.user_id = q""",
)
def g11(spark, sf_dir):
    """Nearest series for a stated query set: users whose id is divisible by 50, against all."""
    series = user_series(spark, sf_dir)
    best = nearest(series.where("user_id % 50 = 0"), series)
    return best.select(F.col("q").alias("user_id"), "nearest", rounded(F.col("rmse")).alias("rmse"), (F.col("rmse") / F.greatest("span", F.lit(1e-8)) <= 0.10).alias("accepted"))
