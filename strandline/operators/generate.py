"""Generated cases, their checks and expectations, and samples: ranges, templates and ranks, no driver loop over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import examples, query
from ..functions import primitives as P
from ..plans import execute as X
from ..plans import plan as L
from ..plans.repair import new_step
from ..sources.series import rounded, rounded_sql
from . import claims, retrieval
from . import scoring as S

LENGTH = 100
# The patterns of each category in order, as primitives (an adversarial one may have to be declined).
PATTERNS = {
    "atomic": [[f"add_{n}"] for n in "flat plateau ramp trend growth decay change_point level_shift seasonality peak trough spike dip outlier gap noise".split()],
    "compositional": [[f"add_{n}" for n in p.split("+")] for p in "flat+spike+trend ramp+dip+plateau flat+peak+trough flat+level_shift+flat flat+seasonality+noise flat+noise+volatility flat+change_point+plateau growth+outlier+level_shift decay+trough+gap flat+spike+dip+peak ramp+decay+flat flat+seasonality+ramp".split()],
    "adversarial": [["add_flat"], ["add_noise"], ["add_volatility"], ["add_gap"], ["add_spike"], ["add_peak"], ["add_dip"], ["add_change_point"], ["add_noise"], [], [], []],
}
UNSUPPORTED = {9: "long_memory_mean_reversion", 10: "calendar_regime", 11: "autoregressive_process"}
TARGETS = {"atomic": 334, "compositional": 332, "adversarial": 334}


def _draw(key: Column, salt: str, low: float, high: float) -> Column:
    """A seeded number for a case, to six digits; hashes in place of a serial generator."""
    share = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return F.round(low + share * (high - low), 6)


def _step_of(name: str, k: int, of: int, key: Column) -> Column:
    """The k-th of a pattern's steps, in its part of the horizon."""
    a, b = k * LENGTH // of, (k + 1) * LENGTH // of - 1
    span = {"start_timestep": F.lit(a), "end_timestep": F.lit(b)}
    at, level, size = (F.lit(a + 5) + _draw(key, f"at{k}", 0, max(1, b - a - 10)).cast("int")), _draw(key, f"level{k}", -10, 10), _draw(key, f"size{k}", 1, 8)
    parameters = {
        "add_flat": span | {"target_value": level}, "add_plateau": span | {"target_value": level}, "add_ramp": span | {"start_value": level, "end_value": level + size}, "add_trend": span | {"slope": size / 100}, "add_growth": span | {"start_value": level, "end_value": level + size, "growth_rate": F.lit(2.0)},
        "add_decay": span | {"start_value": level + size, "end_value": level, "decay_rate": F.lit(2.0)}, "add_change_point": {"anchor_timestep": at, "level_change": size}, "add_level_shift": {"start_timestep": at, "shift": size}, "add_seasonality": span | {"amplitude": size, "period": F.lit(10.0)},
        "add_peak": span | {"timestep": at, "target_value": level + 20, "width": F.lit(2.0)}, "add_trough": span | {"timestep": at, "target_value": level - 20, "width": F.lit(2.0)}, "add_spike": {"timestep": at, "amplitude": size}, "add_dip": {"timestep": at, "amplitude": size}, "add_outlier": {"timestep": at, "target_value": level + 30},
        "add_gap": span | {"fill_value": F.lit(0.0)}, "add_noise": span | {"noise_scale": F.lit(0.2), "random_seed": F.lit(7)}, "add_volatility": span | {"volatility_scale": F.lit(2.0), "baseline": F.lit(0.0)},
    }
    stated = F.concat_ws(", ", *[F.concat(F.lit(f"{p.replace('_', ' ')} "), v.cast("string")) for p, v in parameters[name].items()])
    return new_step(f"step_{k + 1}", name, parameters[name], name.removeprefix("add_"), F.concat(F.lit(f"{name.removeprefix('add_').replace('_', ' ')} with "), stated), 1.0)


def generated(spark: SparkSession, targets: dict[str, int] = TARGETS) -> DataFrame:
    """Rows ``case_id, category, number, description, length, steps, unsupported`` for so many cases of each category."""
    parts = []
    for category, patterns in PATTERNS.items():
        key = F.concat(F.lit(f"{category}_"), F.col("number").cast("string"))
        none = F.array().cast(f"array<{L.STEP}>")
        steps, open_items = F.when(F.lit(False), none), F.when(F.lit(False), F.array().cast("array<string>"))
        for i, names in enumerate(patterns):
            made = F.array(*[_step_of(n, k, len(names), key) for k, n in enumerate(names)]) if names else none
            steps = steps.when(F.col("number") % len(patterns) == i, made)
            if category == "adversarial" and i in UNSUPPORTED:
                open_items = open_items.when(F.col("number") % len(patterns) == i, F.array(F.lit(UNSUPPORTED[i])))
        rows = spark.range(targets[category]).select(F.col("id").alias("number")).withColumns({"category": F.lit(category), "case_id": key, "length": F.lit(LENGTH), "steps": steps, "unsupported": F.coalesce(open_items, F.array().cast("array<string>"))})
        parts.append(rows.withColumn("description", F.concat_ws("; ", F.concat_ws("; ", F.transform("steps", lambda s: s["source_text"])), F.concat_ws("; ", "unsupported"))))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def derived_checks(s: Column, steps: Column) -> Column:
    """Signal checks that an executed series fulfils: its length, bounds and extremes, values at events, flat stretches that last."""
    finite = P.finite(s)
    at = lambda x: F.array_position(s, x).cast("int") - 1
    around = lambda i: F.array(F.greatest(F.lit(0), i - 2), F.least(F.size(s) - 1, i + 2))
    events = F.transform(F.filter(steps, lambda x: x["primitive"].isin(*L.EVENTS)), lambda x: F.struct(L.whole(x, "timestep").alias("timestep"), F.get(s, L.whole(x, "timestep")).alias("value"), F.lit(1e-6).alias("tolerance")))
    level = lambda x: F.struct(L.whole(x, "start_timestep").alias("start"), L.whole(x, "end_timestep").alias("end"), L.number(x, "target_value").alias("value"), F.lit(1e-6).alias("tolerance"))
    flats = F.filter(F.transform(F.filter(steps, lambda x: x["primitive"].isin("add_flat", "add_plateau")), level), lambda c: F.forall(P.window(s, c["start"], c["end"]), lambda v: F.abs(v - c["value"]) <= 1e-6))
    return F.struct(
        F.size(s).alias("length"), F.filter(events, lambda e: e["value"].isNotNull()).alias("point_values"), flats.alias("constant_segments"), F.lit(None).alias("unchanged_windows"), F.lit(None).alias("monotone_windows"), around(at(F.array_max(finite))).alias("argmax_in"), around(at(F.array_min(finite))).alias("argmin_in"),
        F.struct(F.array_min(finite).alias("min"), F.array_max(finite).alias("max")).alias("value_bounds"), F.lit(None).alias("nonconstant_windows"), F.lit(None).alias("variance_comparison"), F.lit(None).alias("periodicity_hint"), F.lit(7).alias("deterministic_seed")).cast(S.CHECKS)


def align_expectations(cases: DataFrame, forbidden: str = "must_not_retrieve") -> DataFrame:
    """Expected candidates become what retrieval gives; what it gives is no longer forbidden."""
    rows = retrieval.retrieve(cases, "description")
    return rows.withColumns({"expected": F.col("candidates"), forbidden: F.array_except(forbidden, "candidates")})


def coverage(cases: DataFrame) -> DataFrame:
    """Cases by category, uses by primitive, declined ones."""
    kinds = F.concat(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("name"))), F.transform("steps", lambda s: F.struct(F.lit("primitive").alias("kind"), s["primitive"].alias("name"))), F.transform("unsupported", lambda u: F.struct(F.lit("unsupported").alias("kind"), u.alias("name"))))
    return cases.select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def audit_report(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, mean scores and claim rates of evaluated captions."""
    usable = F.filter("claims", lambda c: ~c["unverifiable"])
    return rows.groupBy(*keys).agg(F.count("*").alias("cases"), F.avg("consistency_score").alias("mean_consistency"), F.sum(F.size(usable)).alias("claims"), F.avg((F.size(usable) > 0).cast("int")).alias("with_claims"))


def sample(rows: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k rows without replacement, in an order that the seed gives."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(k)


def select_rows(asked: DataFrame, table: DataFrame, place: str = "source_row", caption: str = "caption") -> DataFrame:
    """Adds ``row`` of ``table``: by position, else by the caption with white space as single spaces (the last of equal ones)."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    by_place = table.select(F.col("row").alias("__a"), F.col("row").alias("__p"))
    by_text = table.groupBy(plain(caption).alias("__c")).agg(F.max("row").alias("__b"))
    joined = asked.join(by_place, F.col(place) == F.col("__p"), "left").join(by_text, plain(asked[caption]) == F.col("__c"), "left")
    return joined.withColumn("row", F.coalesce("__a", "__b")).drop("__a", "__b", "__c", "__p")


_NAMES = {c: "[" + ", ".join("'" + "+".join(p) + "'" for p in x) + "]" for c, x in PATTERNS.items()}
_CASES_SQL = " UNION ALL ".join(f"SELECT '{c}_' || i AS case_id, '{c}' AS category, {x}[1 + i % {len(PATTERNS[c])}] AS primitives, {'i % 12 >= 9' if c == 'adversarial' else 'FALSE'} AS declined FROM (SELECT unnest(range(0, {TARGETS[c]})) AS i)" for c, x in _NAMES.items())


@query("g02_generated_cases", _CASES_SQL)
def g02(spark, sf_dir):
    """The controlled cases: patterns in turn in each category."""
    return generated(spark).select("case_id", "category", F.array_join(F.transform("steps", lambda s: s["primitive"]), "+").alias("primitives"), (F.size("unsupported") > 0).alias("declined"))


@query("g03_derived_checks", f"SELECT case_id, TRUE AS all_pass FROM ({_CASES_SQL}) WHERE NOT declined AND category = 'compositional'")
def g03(spark, sf_dir):
    """Checks derived from executed series hold on these series."""
    rows = generated(spark).where("category = 'compositional'").withColumn("z", X.noise_of(F.col("steps"), F.col("length")))
    rows = rows.withColumn("series", X.as_listed(F.col("steps"), F.col("length"), F.col("z"))["values"]).withColumn("checks", derived_checks(F.col("series"), F.col("steps")))
    return rows.select("case_id", F.forall(S.signal_checks(F.col("series"), F.col("checks")), lambda c: c["passed"]).alias("all_pass"))


@query("g05_coverage", f"WITH c AS ({_CASES_SQL}), k AS (SELECT 'category' AS kind, category AS name FROM c UNION ALL SELECT 'primitive', unnest(string_split(primitives, '+')) FROM c WHERE primitives <> '' UNION ALL SELECT 'unsupported', ['{UNSUPPORTED[9]}', '{UNSUPPORTED[10]}', '{UNSUPPORTED[11]}'][string_split(case_id, '_')[2]::INT % 12 - 8] FROM c WHERE declined) SELECT kind, name, count(*) AS n FROM k GROUP BY kind, name")
def g05(spark, sf_dir):
    return coverage(generated(spark))


@query("g04_aligned_expectations", "SELECT user_id, user_id % 2 = 1 AS still_forbidden FROM (SELECT DISTINCT user_id FROM events)")
def g04(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    rows = users.withColumns({"description": F.when(F.col("user_id") % 2 == 0, "A sharp spike.").otherwise("A gap of missing values."), "must_not_retrieve": F.array(F.lit("add_spike"))})
    return align_expectations(rows).select("user_id", (F.size("must_not_retrieve") > 0).alias("still_forbidden"))


@query("g09_seeded_sample", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('42:' || user_id), user_id LIMIT 12")
def g09(spark, sf_dir):
    return sample(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct(), 12, 42, "user_id")


@query("g10_selected_rows", "WITH u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT max(user_id) AS n FROM u) SELECT user_id, CASE WHEN user_id % 3 = 0 THEN user_id WHEN user_id % 3 = 1 THEN (SELECT max(user_id) FROM u WHERE user_id % 2 = 1) ELSE -1 END AS row FROM u, n")
def g10(spark, sf_dir):
    """Rows by position, else by caption, else none."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    table = users.select(F.col("user_id").alias("row"), F.when(F.col("user_id") % 2 == 1, "an  odd\trow").otherwise("an even row").alias("caption"))
    k = F.col("user_id") % 3
    asked = users.withColumns({"source_row": F.when(k == 0, F.col("user_id")), "caption": F.when(k == 1, " an odd row ").when(k == 2, "unknown").otherwise("x")})
    return select_rows(asked, table).select("user_id", F.coalesce("row", F.lit(-1)).alias("row"))


@query("g07_audit_report", f"SELECT user_id % 2 AS part, count(*) AS cases, {rounded_sql('avg((user_id % 2 = 0)::INT)')} AS with_claims FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def g07(spark, sf_dir):
    rows = claims.user_series(spark, sf_dir).withColumn("caption", F.when(F.col("user_id") % 2 == 0, "A clear upward trend.").otherwise("Nothing measurable is said."))
    out = audit_report(claims.evaluate(rows).withColumn("part", F.col("user_id") % 2), "part")
    return out.select("part", "cases", rounded(F.col("with_claims")).alias("with_claims"))


examples("g01_step_windows", [("add_flat",), ("add_peak",)], ["0-99", "0-99"], lambda n: F.when(n == "add_flat", F.concat_ws("-", L.param(_step_of("add_flat", 0, 1, n), "start_timestep"), L.param(_step_of("add_flat", 0, 1, n), "end_timestep"))).otherwise(F.concat_ws("-", L.param(_step_of("add_peak", 0, 1, n), "start_timestep"), L.param(_step_of("add_peak", 0, 1, n), "end_timestep"))))
