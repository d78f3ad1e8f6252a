"""Queries of plan validation, rewriting and execution, over plans that users get by their ids."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import examples, query
from ..plans import execute as X
from ..plans import plan as L
from ..plans import schema as S
from ..plans.registry import PRIMITIVES
from ..sources.series import POINTS_SQL, points, rounded, rounded_sql

_VALID = {"status": "valid", "schema_path": "primitive", "target_path": "registry", "errors": []}


def step(name: str, id: str = "s1", effect: str | None = None, text: str = "said", role: str = "role", extra: dict | None = None, **parameters) -> dict:
    own = PRIMITIVES[name][0] if name in PRIMITIVES else "additive"
    return {"id": id, "kind": "primitive", "primitive": name, "parameters": parameters, "semantic_role": role, "effect_type": effect or own, "confidence": 0.9, "source_text": text, "needs_library_extension": False} | (extra or {})


def unresolved(id: str = "u1", text: str = "odd") -> dict:
    return {"id": id, "kind": "unresolved", "description": text, "semantic_role": text, "confidence": 0.5, "source_text": text, "reason": "none", "needs_library_extension": True}


def plan(*steps: dict, length: int = 40, description: str = "a series", low: float = 0.0, high: float = 10.0, **more) -> str:
    body = {"version": "1.0", "input_description": description, "registry_validation": _VALID, "global_context": {"length": length, "numeric_range": {"min": low, "max": high}}, "steps": list(steps), "unresolved_semantics": [], "needs_library_extension": False}
    return json.dumps(body | more)


FLAT = step("add_flat", target_value=5, start_timestep=0, end_timestep=39)
SPIKE = step("add_spike", "s2", timestep=7, amplitude=3)


def steps_of(text: Column) -> Column:
    return F.from_json(text, L.PLAN)["steps"]


examples(
    "v01_validate_plan",
    [(plan(FLAT, SPIKE),), (plan(FLAT, length=1),), (plan(),), (plan({**FLAT, "effect_type": "neither", "confidence": 2}),), (plan(FLAT, note="x"),), ("no json",), (plan({**FLAT, "kind": "other"}, unresolved()),), (json.dumps({"version": 1}),)],
    ["valid", "invalid $/global_context/length: is under 2", "invalid $/steps: is empty", "invalid $/steps/0/confidence: is over 1; $/steps/0/effect_type: is not allowed", "invalid $: does not know note", "invalid $: is not JSON", "invalid $/steps/0: kind must be one of primitive, unresolved",
     "invalid $/version: must be string; $: misses global_context; $: misses input_description; $: misses needs_library_extension; $: misses registry_validation; $: misses steps; $: misses unresolved_semantics"],
    lambda t: F.trim(F.concat_ws(" ", S.validate("plan", t)["status"], F.array_join(S.validate("plan", t)["errors"], "; "))),
)
_ENTRY = {"name": "add_flat", "category": "base", "description": "level", "args": {"target_value": "level"}, "required_args": ["target_value"], "defaults": {}, "aliases": [], "semantic_triggers": ["flat"], "constraints": {}, "examples": [{"text": "flat", "call": "add_flat(s)"}], "composable_from": []}
examples("v01_validate_registry", [(json.dumps([_ENTRY]),), ("[]",), (json.dumps([_ENTRY, {**_ENTRY, "name": "flat", "examples": []}]),)], ["valid", "invalid $: is empty", "invalid $/1/examples: is empty; $/1/name: does not match"], lambda t: F.trim(F.concat_ws(" ", S.validate("registry", t)["status"], F.array_join(S.validate("registry", t)["errors"], "; "))))
examples(
    "v02_extract_json", [("```json\n" + plan(FLAT) + "\n```",), ("Here it is: " + plan(FLAT, SPIKE) + " Done.",), ("nothing here",), ("{broken",), ("{not: json}",)], ["1", "2", "plan_invalid", "plan_invalid", "plan_invalid"],
    lambda t: F.coalesce(F.when(L.from_text(t).isNotNull(), F.size(L.from_text(t)["steps"]).cast("string")), F.lit("plan_invalid")),
)
examples("v03_lenient_json", [('{"a": 1 + 2, "b": .5, "c": [-.25, 3]}',), ('{"a": -3 + 10}',), ('{"a": 1.5}',)], ['{"a": 3, "b": 0.5, "c": [-0.25, 3]}', '{"a": 7}', '{"a": 1.5}'], L.lenient)
examples(
    "v04_normalize_plan",
    [(plan(FLAT, step("add_noise", "s2", noise_scale=1)),), (plan(FLAT, unresolved("u7", "a calendar effect"), unresolved_semantics=["a calendar effect", "unknown thing", {"id": "k", "description": "d", "source_text": "t", "reason": "r"}]),)],
    ["segment_structure 0,texture 1||", "segment_structure 0,segment_structure 1|u7:a calendar effect,unresolved_2:unknown thing,k:d|none,Model marked this semantic as unresolved.,r"],
    lambda t: F.concat_ws("|", F.array_join(F.transform(L.from_text(t)["steps"], lambda s: F.concat_ws(" ", s["semantic_layer"], s["priority"].cast("string"))), ","), F.array_join(F.transform(L.from_text(t)["unresolved_semantics"], lambda u: F.concat_ws(":", u["id"], u["description"])), ","), F.array_join(F.transform(L.from_text(t)["unresolved_semantics"], lambda u: u["reason"]), ",")),
)
examples("v05_numeric_range", [("0", "1"), ("2", "1"), (None, "1"), ("-Infinity", "1")], [None, "range_reversed", "range_incomplete", "range_not_finite"], lambda a, b: L.range_error(a.cast("double"), b.cast("double")))
examples("v06_cue_kinds", [("a declining flat stretch",), ("Climbs upward",), ("stays constant",), ("repeating pattern with noise",), ("slight jitter",), ("nothing",)], ["decline", "increase", "plateau", "oscillation", "light_noise", None], L.cue_kind)
examples(
    "v07_inferred_constraints",
    [('[{"kind":"decline","source_text":"falls","confidence":0.6},{"kind":"decline","source_text":"falls"},{"kind":"light_noise"}]', "[]"), ("[]", '[{"kind":"monotonicity","value":"nonincreasing"}]'), ("[]", '[{"kind":"slope","source_text":"an upward move"}]'), ('[{"kind":"odd","source_text":"flat"}]', "[]")],
    ["decline:falls,light_noise:light_noise|slope_sign:negative:0.6", "decline:nonincreasing|monotonicity:nonincreasing", "increase:an upward move|slope_sign:positive:0.8", "plateau:flat|slope_sign:zero:0.8"],
    lambda a, b: F.concat_ws("|", F.array_join(F.transform(L.cues(F.from_json(a, f"array<{L.CUE}>"), F.from_json(b, f"array<{L.INFERRED}>")), lambda c: F.concat_ws(":", c["kind"], c["source_text"])), ","),
        F.array_join(F.transform(L.inferred_constraints(F.from_json(b, f"array<{L.INFERRED}>"), L.cues(F.from_json(a, f"array<{L.CUE}>"), F.from_json(b, f"array<{L.INFERRED}>"))), lambda c: F.concat_ws(":", c["kind"], c["value"], c["confidence"].cast("string"))), ",")),
)
examples(
    "v08_parse_plan",
    [(plan(FLAT, SPIKE), "add_flat,add_spike"), (plan(FLAT, length=41), "add_flat"), (plan(FLAT, high=11.0), "add_flat"), (plan(FLAT, registry_validation={**_VALID, "status": "invalid"}), "add_flat"), (plan(FLAT, description=" "), "add_flat"), (plan(FLAT, needs_library_extension=True), "add_flat"),
     (plan(FLAT, unresolved_semantics=[{"id": "u", "description": "d", "source_text": "t", "reason": "r"}]), "add_flat"), (plan(FLAT, unresolved()), "add_flat"), (plan(SPIKE), "add_flat"), (plan(FLAT, SPIKE), "add_spike"), (plan({**FLAT, "effect_type": "additive"}), "add_flat"), (plan(SPIKE, description="It has several peaks."), "add_spike"),
     (plan(SPIKE, {**SPIKE, "id": "s3"}, description="It has several small peaks."), "add_spike"), ("[]", "add_flat"), (plan(FLAT, low=3.0, high=1.0), "add_flat")],
    [None, "plan_invalid:length", "plan_invalid:range", "plan_invalid:registry", "plan_invalid:description", "needs_library_extension:flag", "needs_library_extension:unresolved", "needs_library_extension:unresolved_step", "plan_invalid:not_a_candidate", None, "plan_invalid:effect_type", "plan_invalid:plural_events_missing", None, "plan_invalid:schema", "plan_invalid:range_reversed"],
    lambda t, c: L.parse_error(F.from_json(t, L.PLAN), F.split(c, ","), F.lit(40), F.struct(F.lit(0.0).alias("min"), F.lit(10.0).alias("max"))),
)
examples("v09_implicit_scaffold", [("add_spike,add_noise",), ("add_spike,add_ramp",), ("",)], ["true", "false", "false"], lambda c: L.implicit_scaffold(F.struct(F.lit("add_flat").alias("primitive")), F.lit(0), F.filter(F.split(c, ","), lambda x: x != "")).cast("string"))
examples("v10_plural_events", [("Many troughs appear.", plan(step("add_dip", timestep=3, amplitude=1))), ("Several peaks and troughs.", plan(SPIKE, step("add_dip", timestep=3, amplitude=1))), ("One peak.", plan(FLAT)), ("multiple local distinct peaks", plan(FLAT))], ["plural_events_missing", "plural_events_missing", None, "plural_events_missing"], lambda d, t: L.plural_error(d, steps_of(t)))
_SHOW = lambda steps: F.array_join(F.transform(steps, lambda s: F.concat_ws(" ", s["id"], F.array_join(F.transform(F.array_sort(F.map_entries(s["parameters"])), lambda e: F.concat_ws("=", e["key"], e["value"])), " "))), ";")
examples("v11_drop_null_parameters", [(plan(step("add_flat", target_value=1, start_timestep=None)),), (plan(SPIKE),)], ["s1 target_value=1", "s2 amplitude=3 timestep=7"], lambda t: _SHOW(L.drop_null_parameters(steps_of(t))))
examples("v12_set_context", [(plan(FLAT, length=7),), (plan(FLAT, low=-5.0),)], ["24 -1.0 2.5"] * 2, lambda t: F.concat_ws(" ", *(L.set_context(F.from_json(t, L.PLAN), F.lit(24), F.lit(-1), F.lit(2.5))["global_context"][k].cast("string") for k in ("length",)), *(L.set_context(F.from_json(t, L.PLAN), F.lit(24), F.lit(-1), F.lit(2.5))["global_context"]["numeric_range"][k].cast("string") for k in ("min", "max"))))
_GUESS = "array<struct<id:string,primitive:string,parameters:map<string,string>>>"
examples(
    "v13_merge_parameters",
    [(plan(FLAT, step("add_noise", "s2", noise_scale=1)), json.dumps([{"id": "s1", "primitive": "add_flat", "parameters": {"target_value": 8, "start_timestep": None}}, {"id": "s2", "primitive": "add_noise", "parameters": {}}])), (plan(FLAT), "[]"), (plan(FLAT), json.dumps([{"id": "s1", "primitive": "add_ramp", "parameters": {}}]))],
    ["s1 end_timestep=39 target_value=8;s2 noise_scale=1 random_seed=7", "no_parameters", "primitive_changed"],
    lambda t, g: F.coalesce(L.merge_error(steps_of(t), F.from_json(g, _GUESS)), _SHOW(L.merge_parameters(steps_of(t), F.from_json(g, _GUESS), F.lit(None).cast("long")))),
)
_SHORT = step("add_flat", text="the baseline is 5", target_value=5, start_timestep=0, end_timestep=9)
examples(
    "v14_extend_backgrounds",
    [(plan(_SHORT, step("add_spike", "s2", timestep=20, amplitude=1)),), (plan(_SHORT, step("add_spike", "s2", timestep=5, amplitude=1)),), (plan(step("add_trend", text="a rise", slope=1, start_timestep=0, end_timestep=20), step("add_noise", "s2", text="noise superimposed", noise_scale=1, start_timestep=10)),),
     (plan(step("add_trend", text="a rise", slope=1, start_timestep=0, end_timestep=20), step("add_noise", "s2", text="noise superimposed", noise_scale=1, start_timestep=10), step("add_flat", "s3", target_value=1, start_timestep=25)),)],
    ["s1 end_timestep=39 start_timestep=0 target_value=5;s2 amplitude=1 timestep=20", "s1 end_timestep=9 start_timestep=0 target_value=5;s2 amplitude=1 timestep=5", "s1 end_timestep=39 slope=1 start_timestep=0;s2 noise_scale=1 start_timestep=10", "s1 end_timestep=20 slope=1 start_timestep=0;s2 noise_scale=1 start_timestep=10;s3 start_timestep=25 target_value=1"],
    lambda t: _SHOW(L.extend_backgrounds(steps_of(t), F.lit(40))),
)
_LAYERED = plan(step("add_noise", "n", noise_scale=1), step("add_peak", "p", timestep=9, target_value=8), step("add_gap", "g", start_timestep=3), step("add_change_point", "c", anchor_timestep=12, level_change=1), step("add_ramp", "r", start_timestep=5, end_value=3), FLAT, step("add_spike", "k", timestep=1, amplitude=2))
examples("l01_order", [(_LAYERED,), (plan(step("add_flat", "b", target_value=1), step("add_flat", "a", target_value=1)),), (plan(step("add_flat", "b", target_value=1, extra={"priority": 3}), step("add_trend", "a", slope=1, extra={"priority": 1})),)], ["c,s1,r,k,g,n,p", "b,a", "a,b"], lambda t: F.array_join(F.transform(L.ordered(steps_of(t)), lambda s: s["id"]), ","))
examples("l02_program", [(plan(FLAT, step("add_seasonality", "s2", amplitude=2, period=7.5, waveform="cosine")),)], ["import numpy as np\nfrom primitives import add_flat, add_seasonality\n\nseries = np.zeros(40, dtype=np.float64)\n\nseries = add_flat(series, target_value=5, start_timestep=0, end_timestep=39)\nseries = add_seasonality(series, amplitude=2, period=7.5, waveform='cosine')\n"], lambda t: L.program(steps_of(t), F.lit(40)))
examples("l03_affected", [(plan(s),) for s in (FLAT, step("add_change_point", anchor_timestep=4, level_change=1), step("add_level_shift", start_timestep=6, shift=1), step("add_outlier", timestep=3, delta=1), step("add_spike", timestep=1, amplitude=2, half_width=3), step("add_peak", timestep=9, amplitude=1), step("add_level_shift", anchor_timestep=8, end_timestep=20, shift=1), step("add_noise", noise_scale=1, end_timestep=9))], ["0-39", "4-39", "6-39", "3-3", "0-4", "0-39", "8-20", "0-9"], lambda t: F.concat_ws("-", L.affected(F.get(steps_of(t), F.lit(0)), F.lit(40))["start"].cast("string"), L.affected(F.get(steps_of(t), F.lit(0)), F.lit(40))["end"].cast("string")))

# Execution: plans by user_id, over as many timesteps as the user has events; series in closed form as the oracle.
_ALL = {"start_timestep": 0}
_HOLD = [{"kind": "constant_segment", "start": 0, "end": 9, "value": 10.0}]
PLANS = [
    (plan(step("add_flat", target_value=10, **_ALL), step("add_spike", "s2", timestep=5, amplitude=4, width=1), step("add_trend", "s3", slope=0.5, start_timestep=10, end_timestep=20)), "10 + CASE t WHEN 5 THEN 4 WHEN 4 THEN 2 WHEN 6 THEN 2 ELSE 0 END + CASE WHEN t BETWEEN 10 AND 20 THEN (t - 10) * 0.5 ELSE 0 END", None),
    (plan(step("add_peak", "p", timestep=12, target_value=30, width=2), step("add_ramp", "r", start_value=0, end_value=24, start_timestep=0, end_timestep=24)), "CASE WHEN t <= 24 THEN t ELSE 0 END + 18 * exp(-0.5 * pow((t - 12) / 2.0, 2))", None),
    (plan(step("add_flat", target_value=2, **_ALL, extra={"semantic_layer": "global_scaffold"}), step("add_level_shift", "s2", start_timestep=30, shift=3), step("add_gap", "s3", start_timestep=8, end_timestep=11, fill_value=-1)), "CASE WHEN t BETWEEN 8 AND 11 THEN -1 ELSE 2 + CASE WHEN t >= 30 THEN 3 ELSE 0 END END", None),
    (plan(step("add_flat", target_value=10, **_ALL, extra={"protected_constraints": _HOLD}), step("add_outlier", "s2", timestep=4, target_value=1)), "CASE WHEN t = 4 THEN 1 ELSE 10 END", "protected_constraint_violation"),
    (plan(step("add_flat", target_value=20000, **_ALL)), "20000", "numeric_range_explosion"),
    (plan(step("add_flat", target_value=1, **_ALL), step("add_spike", "s2", timestep=500, amplitude=1)), None, "execution_failed"),
    (plan(step("add_flat", target_value=1, **_ALL), step("add_trend", "s2", semantic="x")), None, "invalid_primitive_args"),
    (plan(step("add_seasonality", "q", amplitude=3, period=8, start_timestep=0, end_timestep=15), step("add_decay", "d", start_value=8, end_value=2, decay_rate=2, start_timestep=20, end_timestep=30)), "CASE WHEN t <= 15 THEN 3 * sin(2 * pi() * t / 8) WHEN t BETWEEN 20 AND 30 THEN 8 - 6 * (1 - exp(-(t - 20) * 0.2)) / (1 - exp(-2.0::DOUBLE)) ELSE 0 END", None),
    (plan(step("add_flat", target_value=3, end_timestep=20), step("add_gap", "g", start_timestep=5, end_timestep=6), step("add_noise", "z", noise_scale=0, start_timestep=0, end_timestep=4)), "CASE WHEN t BETWEEN 5 AND 6 THEN NULL WHEN t <= 20 THEN 3 ELSE 0 END", None),
]


def planned(spark, sf_dir, of: tuple[int, ...] = tuple(range(len(PLANS)))):
    """Rows ``user_id, n, k, plan``; ``of`` are the plans to deal out to the users."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    k = F.get(F.array(*map(F.lit, of)), (F.col("user_id") % len(of)).cast("int"))
    return users.select("user_id", "n", k.alias("k"), F.from_json(F.get(F.array(*[F.lit(p) for p, _, _ in PLANS]), k), L.PLAN).alias("plan"))


def _closed(guarded: bool) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, (_, v, e) in enumerate(PLANS) if v and (e is None or not guarded))
    kept = ", ".join(str(k) for k, (_, v, e) in enumerate(PLANS) if v and (e is None or not guarded))
    return f"WITH {POINTS_SQL} SELECT user_id, t::INT AS t, {rounded_sql(f'CASE user_id % {len(PLANS)} {whens} END::DOUBLE')} AS v FROM p WHERE user_id % {len(PLANS)} IN ({kept})"


def _points(rows, values: str):
    v = F.when(~F.isnan("v"), F.col("v"))
    return points(rows.where(f"{values} is not null"), "user_id", values=values).select("user_id", "t", rounded(v).alias("v"))


@query("x01_execute_plan", _closed(True))
def x01(spark, sf_dir):
    """Series of plans that pass all guards."""
    rows = planned(spark, sf_dir).withColumn("order", L.ordered(F.col("plan.steps"))).withColumn("z", X.noise_of(F.col("order"), F.col("n")))
    return _points(rows.select("user_id", X.fold(F.col("order"), F.col("n"), F.col("z"))["values"].alias("values")), "values")


@query("x02_guards", f"SELECT user_id, [{', '.join('NULL' if e is None else repr(e) for _, _, e in PLANS)}][1 + user_id % {len(PLANS)}] AS error FROM (SELECT DISTINCT user_id FROM events)")
def x02(spark, sf_dir):
    """Why a guard stops a plan: baseline, arguments, stability, protected constraints."""
    rows = planned(spark, sf_dir).withColumn("z", X.noise_of(L.ordered(F.col("plan.steps")), F.col("n")))
    return rows.select("user_id", X.execute(F.col("plan.steps"), F.col("n"), F.col("z"))["error"].alias("error"))


_BARE = [plan(step("add_flat", target_value=1, end_timestep=9), step("add_spike", "s2", timestep=20, amplitude=1)), plan(step("add_gap", "a", start_timestep=0, end_timestep=9, fill_value=4, extra={"semantic_layer": "global_scaffold"}), step("add_spike", "s2", timestep=9, amplitude=1, width=3), step("add_noise", "s3", noise_scale=-1))]
examples("x03_stability", [(b,) for b in (plan(step("add_gap", start_timestep=3)), plan(step("add_gap", start_timestep=3), step("add_flat", "f", target_value=9e9)), plan(FLAT), *_BARE)], [None, "numeric_range_explosion", None, None, "execution_failed"], lambda t: X.execute(steps_of(t), F.lit(40))["error"])
_GUARD = lambda **c: plan(step("add_ramp", start_value=0, end_value=39, start_timestep=0, end_timestep=39, extra={"protected_constraints": [c]}), step("add_outlier", "o", timestep=20, delta=-15, start_timestep=20, end_timestep=20))
examples(
    "x04_protected", [(_GUARD(kind="monotone_window", start=0, end=39, direction="nondecreasing"),), (_GUARD(kind="monotone_window", start=0, end=10, direction="nondecreasing"),), (_GUARD(kind="point_value", timestep=20, value=20.0),), (_GUARD(kind="point_value", timestep=7, value=7.5, tolerance=0.6),), (_GUARD(kind="constant_segment", start=3, end=4, value=3.5, tolerance=0.5),), (_GUARD(kind="monotone_window", start=0, end=5, direction="nonincreasing"),)],
    ["protected_constraint_violation", None, "protected_constraint_violation", None, None, "protected_constraint_violation"], lambda t: X.execute(steps_of(t), F.lit(40))["error"],
)


@query("x05_trace", f"WITH {POINTS_SQL}, s(id, j) AS (VALUES ('s1', 0), ('s3', 1), ('s2', 2)) SELECT user_id, s.id, s.j::INT AS step, {rounded_sql('sum(10 + CASE WHEN j >= 2 AND t = 5 THEN 4 WHEN j >= 2 AND t IN (4, 6) THEN 2 ELSE 0 END + CASE WHEN j >= 1 AND t BETWEEN 10 AND 20 THEN (t - 10) * 0.5::DOUBLE ELSE 0 END)')} AS total FROM p, s GROUP BY user_id, s.id, s.j")
def x05(spark, sf_dir):
    """The series after each step, here by their sums."""
    rows = planned(spark, sf_dir, of=(0,)).select("user_id", F.posexplode(X.replay(F.col("plan.steps"), F.col("n"))["trace"]).alias("step", "x"))
    return rows.select("user_id", F.col("x.id").alias("id"), "step", rounded(F.aggregate("x.values", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("x06_steps_summary", f"WITH {POINTS_SQL}, s(id, j) AS (VALUES ('s1', 0), ('s3', 1), ('s2', 2)), v AS (SELECT user_id, id, t, 10 + CASE WHEN j >= 2 AND t = 5 THEN 4 WHEN j >= 2 AND t IN (4, 6) THEN 2 ELSE 0 END + CASE WHEN j >= 1 AND t BETWEEN 10 AND 20 THEN (t - 10) * 0.5::DOUBLE ELSE 0 END AS v FROM p, s) SELECT user_id, id, {rounded_sql('min(v)')} AS low, {rounded_sql('max(v)')} AS high, {rounded_sql('avg(v)')} AS mean, {rounded_sql('stddev_pop(v)')} AS std FROM v GROUP BY user_id, id")
def x06(spark, sf_dir):
    """Summaries after each step of a guarded replay without gap allowance or constraints."""
    from ..functions import primitives as P

    done = X.execute(F.col("plan.steps"), F.col("n"), gaps_allowed=False, protect=False, traced=True)
    rows = planned(spark, sf_dir, of=(0,)).select("user_id", F.explode(done["trace"]).alias("x"))
    v = F.col("x.values")
    return rows.select("user_id", F.col("x.id").alias("id"), rounded(F.array_min(v)).alias("low"), rounded(F.array_max(v)).alias("high"), rounded(P.mean(v)).alias("mean"), rounded(P.stddev(v)).alias("std"))


@query("x07_listed_order", _closed(False).replace("18 * exp(-0.5 * pow((t - 12) / 2.0, 2))", "CASE WHEN t <= 24 THEN 0 ELSE 30 * exp(-0.5 * pow((t - 12) / 2.0, 2)) END"))
def x07(spark, sf_dir):
    """Steps as they are listed, without guards."""
    rows = planned(spark, sf_dir).withColumn("z", X.noise_of(F.col("plan.steps"), F.col("n")))
    return _points(rows.select("user_id", X.as_listed(F.col("plan.steps"), F.col("n"), F.col("z"))["values"].alias("values")), "values")


_DECLINED = 1
_RUN = (0, _DECLINED, 2, 7)


@query("x08_run_plans", f"SELECT user_id, CASE WHEN k = {_DECLINED} THEN 'rejected' WHEN n <> 60 THEN 'fallback' ELSE 'ok' END AS execution, CASE WHEN n <> 60 AND k <> {_DECLINED} THEN 'plan_invalid:length' END AS warning, k <> {_DECLINED} AS has_series FROM (SELECT user_id, count(*) AS n, {list(_RUN)}[1 + user_id % {len(_RUN)}] AS k FROM events GROUP BY user_id)")
def x08(spark, sf_dir):
    """Declined plans have no series; refused ones run in listed order with a warning."""
    rows = planned(spark, sf_dir, of=_RUN)
    p = F.col("plan").withField("global_context.length", F.lit(60)).withField("needs_library_extension", F.col("k") == _DECLINED)
    done = X.run_plans(rows.withColumn("plan", p), length="n")
    return done.select("user_id", "execution", "warning", F.col("series").isNotNull().alias("has_series"))


_CODE = "import numpy as np\nfrom primitives import add_flat, add_spike\nseries = np.zeros(40)\n"
CODES = [
    (_CODE + "series = add_flat(series, target_value=1)\n", None), (_CODE, "contract_invalid"), ("import os\nseries = add_flat(series, target_value=1)", "contract_invalid"), (_CODE + "while True:\n    pass\n", "contract_invalid"), (_CODE + "series = add_flat(series)\n", "invalid_primitive_args"),
    (_CODE + "series = add_spike(series, timestep=2, amplitude=1, target_value=3)\n", "invalid_primitive_args"), (_CODE + "series = add_spike(series, timestep=2, amplitude=series[3])\n", "additive_as_setter"), ("series = (", "contract_invalid"), (_CODE + "x = add_flat(series, target_value=1)\n", "contract_invalid"), (_CODE + "series = add_ramp(series, end_value=1)\n", "contract_invalid"),
]


@query("x10_program_contract", f"SELECT user_id, [{', '.join('NULL' if e is None else repr(e) for _, e in CODES)}][1 + user_id % {len(CODES)}] AS fault FROM (SELECT DISTINCT user_id FROM events)")
def x10(spark, sf_dir):
    """Generated programs against their contract (parsed, never run)."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    code = F.element_at(F.array(*[F.lit(c) for c, _ in CODES]), (F.col("user_id") % len(CODES) + 1).cast("int"))
    return X.check_programs(users.select("user_id", code.alias("code"), F.array(F.lit("add_flat"), F.lit("add_spike")).alias("candidates"))).select("user_id", "fault")


_TENS = json.dumps([10.0] * 12)
examples("x12_plausibility", [(_TENS, "A stable level near 10.0"), (json.dumps([0.0] * 12), "It ends at 4.5."), (json.dumps([0.0, 20.0] * 6), "Low volatility throughout"), (json.dumps([20000.0] * 9), "It ends at 20000.0"), (_TENS, "It ends near 12.5")], ["", "zero_series_output,endpoint_mismatch", "excessive_variance", "numeric_range_explosion", "endpoint_mismatch"], lambda s, c: F.array_join(X.plausibility(F.from_json(s, "array<double>"), c), ","))
examples("x14_direct_array", [('{"series": [1, 2, 3]}',), ("So: [1.5, 2, 3] done",), ('{"series": [1, 2]}',), ('{"values": [1, 2, 3]}',), ("none",), ('{"series": [[1], [2], [3]]}',)], ["1.0,2.0,3.0", "1.5,2.0,3.0", "length 2 does not match expected length 3", "no_list", "no_list", "not_one_dimensional"], lambda t: F.coalesce(X.direct_array(t, F.lit(3))["error"], F.array_join(F.transform(X.direct_array(t, F.lit(3))["series"], lambda v: v.cast("string")), ",")))
